"""The registered queries and their oracles."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.sources.views import Views, with_views

MODULES = ("pixels", "terrain", "objects", "evaluation", "geometry", "series", "catalogue", "reports", "streams", "workflow")
_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


def query(oracle: str | None = None, recursive: bool = False, name: str | None = None):
    """Register a function of Views as a query; ``oracle`` is its SQL, with views in braces."""

    def add(f: Callable[[Views], DataFrame]):
        key = name or f.__name__
        if key in _queries:
            raise ValueError(f"query {key} is registered twice")
        _queries[key] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if oracle:
            _oracles[key] = with_views(oracle, recursive)
        return f

    return add


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"gridloom.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return _queries


def oracles() -> dict[str, str]:
    _load()
    return _oracles
