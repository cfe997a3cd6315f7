"""Registered queries and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from . import problems, reference

_MODULES = (problems, reference)


def all_queries() -> dict[str, Callable]:
    return {name: f for module in _MODULES for name, f in module.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: text for module in _MODULES for name, text in module.SQL.items()}
