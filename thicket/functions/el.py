"""A small, safe expression language for predicates, translated to columns.

``class_name == 'a' || string.startsWith(full_method, 'p.')`` and the like:
``&& || ! == != < <= > >= + -``, parentheses, numbers, quoted texts, ``true``,
``false``, ``nil``, and the functions below. Only allowed variables may be named; nothing
is evaluated in Python. A true expression drops the row it is asked about.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from thicket.functions.predicates import any_of

_TOKEN = re.compile(
    r"\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_][\w.]*)"
    r"|(?P<op>&&|\|\||==|!=|<=|>=|[!<>(),+\-]))"
)


class ElError(ValueError):
    """A predicate that can't be used; names its setting."""


def _any(test: Callable[[Column, Column], Column]) -> Callable[..., Column]:
    return lambda c, *words: any_of([test(c, w) for w in words])


def _ic(f: Callable[..., Column]) -> Callable[..., Column]:
    return lambda c, *words: f(F.lower(c), *[F.lower(w) for w in words])


_ONE: dict[str, Callable[[Column, Column], Column]] = {
    "startsWith": lambda c, w: F.startswith(c, w),
    "endsWith": lambda c, w: F.endswith(c, w),
    "contains": lambda c, w: F.contains(c, w),
    "equals": lambda c, w: c == w,
}
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "string.length": lambda c: F.length(c),
    "include": lambda c, w: F.array_contains(c, w),
}
for _name, _f in _ONE.items():
    FUNCTIONS[f"string.{_name}"] = _f
    FUNCTIONS[f"string.{_name}Any"] = _any(_f)
    FUNCTIONS[f"string.{_name}IC"] = _ic(_f)
    FUNCTIONS[f"string.{_name}AnyIC"] = _ic(_any(_f))


class _Parser:
    def __init__(self, text: str, variables: Mapping[str, Column], setting: str):
        self.setting, self.variables = setting, variables
        self.tokens, pos = [], 0
        while text[pos:].strip():
            m = _TOKEN.match(text, pos)
            if not m:
                raise self.error(f"can't read {text[pos:]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            pos = m.end()
        self.at = 0

    def error(self, why: str) -> ElError:
        return ElError(f"{self.setting}: {why}")

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] == "op" else None

    def take(self, op: str) -> bool:
        if self.peek() == op:
            self.at += 1
            return True
        return False

    def whole(self) -> tuple[Column, bool]:
        out = self.either()
        if self.at < len(self.tokens):
            raise self.error(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def either(self) -> tuple[Column, bool]:
        left, boolean = self.both()
        while self.take("||"):
            right, b = self.both()
            self.need(boolean and b)
            left = left | right
        return left, boolean

    def both(self) -> tuple[Column, bool]:
        left, boolean = self.compare()
        while self.take("&&"):
            right, b = self.compare()
            self.need(boolean and b)
            left = left & right
        return left, boolean

    def compare(self) -> tuple[Column, bool]:
        left, boolean = self.sum()
        op = self.peek()
        if op in ("==", "!=", "<", "<=", ">", ">="):
            self.at += 1
            right, _ = self.sum()
            same = left.eqNullSafe(right)
            return {"==": same, "!=": ~same}.get(op) if op in ("==", "!=") else {
                "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right
            }[op], True
        return left, boolean

    def sum(self) -> tuple[Column, bool]:
        left, boolean = self.unary()
        while (op := self.peek()) in ("+", "-"):
            self.at += 1
            right, _ = self.unary()
            left, boolean = (left + right if op == "+" else left - right), False
        return left, boolean

    def unary(self) -> tuple[Column, bool]:
        if self.take("!"):
            c, b = self.unary()
            self.need(b)
            return ~c, True
        if self.take("("):
            out = self.either()
            if not self.take(")"):
                raise self.error("missing )")
            return out
        if self.at >= len(self.tokens):
            raise self.error("ends too early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return F.lit(float(text) if "." in text else int(text)), False
        if kind == "str":
            return F.lit(re.sub(r"\\(.)", r"\1", text[1:-1])), False
        if kind == "name" and self.take("("):
            args = []
            while not self.take(")"):
                args.append(self.either()[0])
                if not self.take(",") and self.peek() != ")":
                    raise self.error("missing )")
            if text not in FUNCTIONS:
                raise self.error(f"unknown function {text}")
            try:
                return FUNCTIONS[text](*args), text != "string.length"
            except TypeError:
                raise self.error(f"wrong number of arguments for {text}") from None
        if kind == "name":
            if text in ("true", "false"):
                return F.lit(text == "true"), True
            if text == "nil":
                return F.lit(None), False
            if text not in self.variables:
                raise self.error(f"unknown variable {text}")
            return self.variables[text], False
        raise self.error(f"unexpected {text!r}")

    def need(self, boolean: bool) -> None:
        if not boolean:
            raise self.error("logical operators need conditions")


def translate(text: str | None, variables: Mapping[str, Column], setting: str = "predicate") -> Column | None:
    """The condition as a column; None for a blank expression, which drops nothing."""
    if not (text or "").strip():
        return None
    column, boolean = _Parser(text, variables, setting).whole()
    if not boolean:
        raise ElError(f"{setting}: the expression is no condition")
    return F.coalesce(column, F.lit(False))


def split_by(df: DataFrame, text: str | None, variables: Mapping[str, Column], setting: str = "predicate") -> tuple[DataFrame, DataFrame]:
    """(rows kept, rows dropped) by the expression."""
    drop = translate(text, variables, setting)
    return (df, df.limit(0)) if drop is None else (df.where(~drop), df.where(drop))
