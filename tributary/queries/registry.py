"""Registration of queries beside their SQL."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None, name: str | None = None):
        """Register the decorated query under its name, with the SQL that must give the same rows."""

        def register(query: Callable) -> Callable:
            key = name or query.__name__
            self.queries[key] = query
            if sql:
                self.sql[key] = sql
            return query

        return register
