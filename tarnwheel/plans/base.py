"""Registers of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable


class Register:
    """Queries of a module by name; `sql` is the query in SQL over the same tables, where SQL can say it."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            if name in self.queries:
                raise ValueError(f"{name} is registered twice")
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return add
