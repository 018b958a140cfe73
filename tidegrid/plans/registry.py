"""Registry of named queries, each with its plain-SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .layers import DerivedLayers
from .sql import with_layers

_QUERIES: dict[str, Callable[[DerivedLayers], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(layers) -> DataFrame`` under a name.

    ``sql`` is the same question for a plain SQL engine, written against the
    layer names; the definitions of the layers are put in front of it.
    """

    def add(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = with_layers(sql)
        return fn

    return add


def _bound(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(DerivedLayers(spark, sf_dir))

    run.__name__ = getattr(fn, "__name__", "run")
    run.__doc__ = fn.__doc__
    return run


def _load() -> None:
    from . import keyed, outlines, records, single_layer, spatial, stores  # noqa: F401


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: _bound(fn) for name, fn in _QUERIES.items()}


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
