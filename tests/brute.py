"""Plain single-process versions of operators that SQL can't express."""

from __future__ import annotations

import json

PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">"}


def split_field(text: str, blanks: bool) -> list[str]:
    """Values of a packed field with balanced quotes and brackets, character by character."""
    s = text.strip()

    def pieces(s: str) -> tuple[list[str], bool]:
        """Parts between top-level delimiters, and whether one pair of brackets encloses all of ``s``."""
        out, cur, stack, quote, i, first_close = [], "", [], "", 0, -1
        while i < len(s):
            c = s[i]
            cur += c
            if quote:
                if c == "\\" and i + 1 < len(s):
                    i += 1
                    cur += s[i]
                elif c == quote and s[i + 1 : i + 2] == quote:
                    i += 1
                    cur += c
                elif c == quote:
                    quote = ""
            elif c in "\"'`":
                quote = c
            elif c in PAIRS:
                stack.append(PAIRS[c])
            elif stack and c == stack[-1]:
                stack.pop()
                if not stack and first_close < 0:
                    first_close = i
            elif not stack and (c in ",;|\n\r\t，；、" or (blanks and c == " ")):
                out.append(cur[:-1])
                cur = ""
            i += 1
        return [*out, cur], s[0] in PAIRS and first_close == len(s) - 1

    if not s:
        return []
    got, whole = pieces(s)
    if whole:
        got = pieces(s[1:-1])[0] if s[1:-1] else []
    items = []
    for x in (g.strip() for g in got):
        if len(x) > 1 and x[0] in "\"'`" and x[-1] == x[0]:
            x = x[1:-1].replace("\\" + x[0], x[0]).replace(x[0] * 2, x[0])
        if x:
            items.append(x)
    return items


def list_objects(body: str | None) -> list[tuple[str, str]]:
    """(path, owner_path) of the objects that are list elements in a JSON text."""
    found: list[tuple[str, str]] = []

    def opened(v):
        if isinstance(v, str):
            try:
                inner = json.loads(v)
            except ValueError:
                return v
            return inner if isinstance(inner, (dict, list)) else v
        return v

    def walk(v, path, owner, element):
        v = opened(v)
        if isinstance(v, dict):
            if element:
                found.append((path, owner))
            for k, x in v.items():
                walk(x, f"{path}.{k}", path if element else owner, False)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, f"{path}[{i}]", owner, True)

    try:
        walk(json.loads(body or ""), "$", "$", False)
    except ValueError:
        pass
    return found
