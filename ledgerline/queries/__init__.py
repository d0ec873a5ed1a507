"""Registered queries: each runs one capability over the given tables.

A query has a name, a function ``(spark, folder) -> DataFrame`` and, where SQL can
state the same result, that SQL. Amounts are rounded off the decimal grid on
both sides (see ``functions.scalars.fixed_round``), dates leave as text.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

_MODULES = [
    "cleaning", "joining", "aggregating", "windowing", "ranking", "series", "models", "selection", "orders", "reports",
    "evaluation", "catalogue", "files", "learning",
]


def query(name: str, sql: str | None = None):
    def register(fn: Callable) -> Callable:
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def load_all() -> None:
    for module in _MODULES:
        import_module(f"{__name__}.{module}")
