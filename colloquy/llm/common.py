"""Helpers shared by the operators of this sub-package."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.session import checkpoint_dir

NO_ID = -(1 << 63)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_shuffles(spark: SparkSession) -> None:
    """Collect the driver's garbage at once, upon which Spark deletes the
    shuffle files of plans that have ended."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def keep(df: DataFrame, release: bool = False) -> DataFrame:
    """Write to the cluster's shared checkpoint folder and read from there:
    compressed, and later readers take only the columns they need. With
    ``release``, garbage is collected after it (see there)."""
    spark = df.sparkSession
    folder = f"{checkpoint_dir(spark)}/kept-{uuid.uuid4()}"
    df.write.parquet(folder)
    if release:
        free_shuffles(spark)
    return spark.read.schema(df.schema).parquet(folder)


@contextmanager
def emptied(*caches: dict) -> Iterator[None]:
    """Empties a worker's caches at the end of a task. Workers outlive their
    tasks, so what they keep would lie beside the memory of later stages,
    those without Python too."""
    try:
        yield
    finally:
        for cache in caches:
            cache.clear()
        pa.default_memory_pool().release_unused()


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """``_uid, _th``: identity of a row by id and content. Rows that agree in
    both are repeats of one row and get the same result; a NULL id counts as
    the smallest id."""
    return [F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("_uid"),
            F.xxhash64(F.col(text_col)).alias("_th")]


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row ``(node, comp)`` per
    node of any edge, ``comp`` the smallest node of its component.

    Alternating star contraction: every round links each node's larger
    neighbours to its smallest one, then its smaller neighbours to the
    smallest. The rows of a round never outnumber the edges, hubs are
    aggregated map-side, and a round's edges are checkpointed so a lost
    executor does not replay the earlier ones. Empty edges give no rows;
    self-loops are ignored; NULL ends are dropped.
    """
    cur = keep(edges.select("a", "b").where("a <> b").distinct())
    previous = None
    for _ in range(max_rounds):
        both = cur.select("a", "b").unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.where("b > a").join(least, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        nxt = keep(large.join(least, "a")
                   .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")),
                                             F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
                   .select("e.a", "e.b").where("a <> b").distinct())
        mark = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        cur = nxt
        if mark == previous:
            break
        previous = mark
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return cur.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots)


NEEDED_SLOTS = 1 << 20


def maybe_needed(rows: DataFrame, wanted: DataFrame, keys: list[str], slots: int = NEEDED_SLOTS) -> DataFrame:
    """``rows`` without those whose key falls in no slot of a ``wanted`` key,
    left out before any shuffle; the slots sent to the executors are at most
    ``slots`` integers."""
    slot = F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int").alias("_slot")
    taken = F.broadcast(wanted.select(slot).distinct())
    return rows.withColumn("_slot", slot).join(taken, "_slot", "left_semi").drop("_slot")


def only_needed(rows: DataFrame, wanted: DataFrame, keys: list[str], slots: int = NEEDED_SLOTS) -> DataFrame:
    """``rows`` joined with ``wanted`` on ``keys``, the same with or without
    what ``maybe_needed`` leaves out."""
    return maybe_needed(rows, wanted, keys, slots).join(wanted, keys)
