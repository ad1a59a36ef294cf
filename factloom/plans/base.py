"""How a module of plans registers its queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable


class Plans:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracle: dict[str, str] = {}

    def __call__(self, sql: str | None = None, name: str | None = None):
        def register(fn):
            key = name or fn.__name__
            self.queries[key] = fn
            if sql:
                self.oracle[key] = sql
            return fn

        return register
