"""Table scans (SRC3): Parquet tables by name, pruned by their consumers."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations")
TASK_ROWS = 250_000


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Lazily scan ``<root>/<name>.parquet``; column pruning and predicate
    pushdown happen when a consumer selects and filters."""
    return spark.read.parquet(os.path.join(root, f"{name}.parquet"))


def tasks_for(rows: int) -> int:
    """Tasks for work that holds its rows in memory; it grows with the rows."""
    return rows // TASK_ROWS + 1


def read_tables(spark: SparkSession, root: str, names=DRIVER_TABLES) -> dict[str, DataFrame]:
    return {n: read_table(spark, root, n) for n in names}
