"""A named collection of queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Query:
    run: Callable
    sql: str | None


class Book(dict):
    def add(self, name: str, sql: str | None = None):
        """Register the decorated ``(spark, sf_dir) -> DataFrame`` under ``name``."""

        def register(fn):
            if name in self:
                raise ValueError(f"query {name} registered twice")
            self[name] = Query(fn, sql)
            return fn

        return register
