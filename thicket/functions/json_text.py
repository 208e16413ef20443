"""Exact reading of JSON texts that the engine's parser refuses, without recursion.

The engine's parser gives nothing for valid texts that are nested beyond its
depth, repeat a member's name, or hold numbers, names or texts beyond its size
limits. Those, and only those, are read here: members keep their order and their
repeats, depth and length are bounded by memory alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from json.decoder import scanstring

_BLANK = r"[ \t\r\n]*+"
_TOKEN = re.compile(
    _BLANK + r'(?:([\[\]{},:])|"((?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+)"'
    r"|(-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?)|(true|false|null))"
)
_OPENS = re.compile(_BLANK + r"[\[{]")
_REST = re.compile(_BLANK)


class Members(list):
    """(name, value) of an object's members, as written."""


class Plain(str):
    """A number or word, as written."""


def parse(text: str) -> object:
    """The value of ``text``: Members, list, str or Plain. ValueError unless all of it is one valid value."""
    root: list = []
    stack: list[tuple[list, str | None]] = []  # open containers with the name that waits for its value
    at, name, box, want = 0, None, root, "value"
    while True:
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError("no token")
        at = m.end()
        kind = m.lastindex
        mark = m.group(1)
        if want in ("value", "value or end") and mark not in (",", ":", "}", "]"):
            if kind == 1:
                new: list = Members() if mark == "{" else []
                box.append((name, new) if isinstance(box, Members) else new)
                stack.append((box, name))
                box, name = new, None
                want = "name or end" if mark == "{" else "value or end"
                continue
            value = scanstring(text, m.start(2), True)[0] if kind == 2 else Plain(m.group(kind))
            box.append((name, value) if isinstance(box, Members) else value)
            want = "next"
        elif want in ("name", "name or end") and kind == 2:
            name = scanstring(text, m.start(2), True)[0]
            m = _TOKEN.match(text, at)
            if not m or m.group(1) != ":":
                raise ValueError("no colon")
            at, want = m.end(), "value"
            continue
        elif mark in ("}", "]") and box is not root and isinstance(box, Members) == (mark == "}") and (want == "next" or want.endswith("end")):
            box, name = stack.pop()
            want = "next"
        elif want == "next" and mark == "," and box is not root:
            want = "name" if isinstance(box, Members) else "value"
        else:
            raise ValueError("out of place")
        if box is root and want == "next":
            if _REST.match(text, at).end() != len(text):
                raise ValueError("more than one value")
            return root[0]


def container(text: str) -> list | None:
    """The object or list that ``text`` is by itself, else None."""
    if not _OPENS.match(text):
        return None
    try:
        return parse(text)
    except ValueError:
        return None


def _entered(value: object) -> object:
    if isinstance(value, str) and not isinstance(value, Plain):
        inner = container(value)
        return value if inner is None else inner
    return value


def walk(body: str) -> Iterator[tuple[str, str, bool, list]]:
    """(path, owner_path, is list element, content) of every object and list of a body, texts that are JSON entered; nothing if invalid."""
    try:
        stack = [("$", "$", False, _entered(parse(body)))]
    except ValueError:
        return
    while stack:
        path, owner, element, value = stack.pop()
        if isinstance(value, Members):
            value = Members((k, _entered(v)) for k, v in value)
            yield path, owner, element, value
            mine = path if element else owner
            stack += [(f"{path}.{k}", mine, False, v) for k, v in value if isinstance(v, list)]
        elif isinstance(value, list):
            value = [_entered(v) for v in value]
            yield path, owner, element, value
            stack += [(f"{path}[{i}]", owner, True, v) for i, v in enumerate(value) if isinstance(v, list)]


def _text(value: str) -> str | None:
    return None if isinstance(value, Plain) and value == "null" else str(value)


def list_objects(body: str) -> list[tuple[str, str, int]]:
    """(path, owner_path, n_members) of the objects that are list elements."""
    return [(path, owner, len(x)) for path, owner, element, x in walk(body) if element and isinstance(x, Members)]


def object_fields(body: str) -> list[tuple[str, str, str, str | None]]:
    """(object_path, owner_path, name, value) of the plain members of all objects; numbers as written, null for JSON's null."""
    return [
        (path, path if element else owner, k, _text(v))
        for path, owner, element, x in walk(body)
        if isinstance(x, Members)
        for k, v in x
        if not isinstance(v, list)
    ]


def leaves(body: str) -> list[tuple[str, str | None]]:
    """(path, value) of the plain members of all objects and the plain elements of all lists."""
    out = []
    for path, _, _, x in walk(body):
        named = [(f".{k}", v) for k, v in x] if isinstance(x, Members) else [(f"[{i}]", v) for i, v in enumerate(x)]
        out += [(path + at, _text(v)) for at, v in named if not isinstance(v, list)]
    return out
