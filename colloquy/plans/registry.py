"""Registry of the named queries: each has a Spark builder over the driver
tables (through the bindings) and, where SQL can say the same thing, an
independent DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import apply_required_conf

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    sql: str | None
    doc: str


_REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    """Decorator: register ``fn(spark, root) -> DataFrame`` under ``name``."""

    def wrap(fn: Builder) -> Builder:
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name}")

        def build(spark: SparkSession, root: str) -> DataFrame:
            apply_required_conf(spark)
            return fn(spark, root)

        build.__name__ = fn.__name__
        build.__doc__ = fn.__doc__
        _REGISTRY[name] = Query(name, build, sql, (fn.__doc__ or "").strip())
        return build

    return wrap


def all_queries() -> dict[str, Query]:
    _load()
    return dict(_REGISTRY)


def _load() -> None:
    # Importing the catalogs fills the registry.
    from . import (catalog_actions, catalog_bundles, catalog_detail, catalog_entities, catalog_graph,  # noqa: F401
                   catalog_meetings, catalog_search, catalog_segments, catalog_topics)
