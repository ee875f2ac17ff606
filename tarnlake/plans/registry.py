"""How a module of registered queries collects them, with their SQL."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """Queries by name, and for those that SQL can express the same result in ANSI SQL."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        def add(fn):
            self.queries[name] = fn
            if sql:
                self.sql[name] = sql
            return fn

        return add


def quoted(text: str) -> str:
    """A text as an SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"
