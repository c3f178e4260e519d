"""Table sinks: schema alignment, key checks, insert-ignore, upsert,
row-count audit and samples (SNK2-SNK7); ``stored`` writes them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class KeyViolation(ValueError):
    pass


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """SNK2: columns in schema order, cast to the declared types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def key_violations(df: DataFrame, keys: Sequence[str], tasks: int | None = None) -> DataFrame:
    """SNK3: key values that are NULL or occur more than once (partially
    aggregated, so a repeated hot key costs one row per task). With ``tasks``,
    for keys that hardly repeat, the rows are dealt by key to so many tasks
    instead, so that no task holds more of them as the table grows."""
    if tasks:
        df = df.repartition(tasks, *keys)
    nulls = F.lit(False)
    for k in keys:
        nulls = nulls | F.col(k).isNull()
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.max(nulls).alias("has_null"))
            .filter((F.col("rows") > 1) | F.col("has_null")).drop("has_null"))


def enforce_keys(df: DataFrame, keys: Sequence[str], table: str) -> None:
    """Fail the load when a primary key repeats or is NULL."""
    bad = key_violations(df, keys).limit(5).collect()
    if bad:
        raise KeyViolation(f"{table}: duplicate or NULL key {list(keys)}: {[tuple(r) for r in bad]}")


def insert_ignore(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SNK4: keep one row per key (every column is key in the tables that
    use it, so which row stays does not matter)."""
    return df.dropDuplicates(list(keys))


def upsert_last(df: DataFrame, key: str, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """SNK5: one row per key holding the values of the row that is last in
    ``order`` (``max_by`` over a struct, combined map-side)."""
    seq = F.struct(*[F.col(c) for c in order])
    agg = df.groupBy(key).agg(F.max_by(F.struct(*[F.col(v) for v in values]), seq).alias("_v"))
    return agg.select(key, *[F.col(f"_v.{v}").alias(v) for v in values])


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """SNK6: (table, rows) for every table, one aggregate each."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def sample(df: DataFrame, order: Sequence[str], n: int = 5, columns: Sequence[str] | None = None) -> DataFrame:
    """SNK7: the first n rows in a fixed order (deterministic sample)."""
    s = df.orderBy(*order).limit(n)
    return s.select(*columns) if columns else s
