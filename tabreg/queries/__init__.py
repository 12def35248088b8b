"""Named queries over the test tables, with comparison SQL."""

from __future__ import annotations

from importlib import import_module

from tabreg.queries.catalog import ORACLES, QUERIES

MODULES = ("cleaning", "ordered", "features", "modelling")


def _load() -> None:
    for m in MODULES:
        import_module(f"tabreg.queries.{m}")


def all_queries() -> dict:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict:
    _load()
    return dict(ORACLES)
