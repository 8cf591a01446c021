"""Registered queries over the given tables, with their SQL checks."""

from __future__ import annotations

from importlib import import_module

from .registry import CHECKS, QUERIES, Query

_MODULES = ["scalars", "sources", "units", "sheets", "matching", "checks", "lineage"]


def _load() -> None:
    for name in _MODULES:
        import_module(f"{__name__}.{name}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_checks() -> dict[str, str]:
    _load()
    return dict(CHECKS)
