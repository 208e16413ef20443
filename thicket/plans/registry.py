"""Collects the queries of a plan module with their SQL."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """``@r.query(name, sql)`` adds a callable(spark, folder); ``sql`` None where SQL can't tell the result."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            assert name not in self.queries, name
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return add
