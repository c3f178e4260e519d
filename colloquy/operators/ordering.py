"""Ordinals and top-k inside groups that stay balanced when one group is huge.

``row_number() OVER (PARTITION BY g ORDER BY k)`` hash-partitions on ``g``,
so a group holding a third of all rows lands in one task. ``group_ordinals``
instead sorts globally on ``(g, k)``: the range partitioner samples the full
key, so a hot group is cut into many range partitions ("chunks"). Chunk sizes
are pre-aggregated (at most one row per group and partition), turned into
offsets with a window over that small table, and joined back on
``(g, chunk)`` -- a key no larger than one partition.

Both the chunk counts and the join read the same sorted rows. Two separate
sorts could cut the data at different boundaries (range sampling seeds and
adaptive partition coalescing differ per exchange), so the sorted, tagged
rows are materialised once with a reliable checkpoint in the cluster's
checkpoint folder; that also cuts the lineage and survives executor loss.
Select only the needed columns before calling.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_POS_BITS = 33  # monotonically_increasing_id = partition << 33 | position


def _cols(xs: str | Sequence[str]) -> list[str]:
    return [xs] if isinstance(xs, str) else list(xs)


def group_ordinals(df: DataFrame, group: str | Sequence[str], order: Sequence[str | Column],
                   ordinal_col: str = "ordinal", size_col: str | None = None,
                   descending: bool = False) -> DataFrame:
    """Add a 1-based ``ordinal_col`` numbering rows within each group in
    ``order`` (ascending, or descending when ``descending``) and optionally the
    group's row count as ``size_col``.

    The order must be total within a group (end it with a unique column):
    then the numbering is deterministic and recomputation after a lost
    executor yields the same ordinals.
    """
    gcols = _cols(group)
    okeys = [F.col(o) if isinstance(o, str) else o for o in order]
    if descending:
        okeys = [k.desc() for k in okeys]
    sorted_df = df.orderBy(*[F.col(g) for g in gcols], *okeys)
    tagged = cut_lineage(sorted_df.withColumn("_rid", F.monotonically_increasing_id()))
    tagged = (tagged.withColumn("_chunk", F.shiftright(F.col("_rid"), _POS_BITS))
              .withColumn("_pos", F.col("_rid").bitwiseAND(F.lit((1 << _POS_BITS) - 1))))
    chunks = tagged.groupBy(*gcols, "_chunk").agg(F.count(F.lit(1)).alias("_cnt"),
                                                  F.min("_pos").alias("_start"))
    before = Window.partitionBy(*gcols).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("_offset", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
    if size_col:
        chunks = chunks.withColumn(size_col, F.sum("_cnt").over(Window.partitionBy(*gcols)))
    keep = ["_offset", "_start"] + ([size_col] if size_col else [])
    right = chunks.select(*[F.col(g).alias(f"_k{i}") for i, g in enumerate(gcols)],
                          F.col("_chunk").alias("_kc"), *keep)
    # NULL group keys form one group, as in a window partition, so the join
    # back is null-safe
    cond = F.col("_chunk") == F.col("_kc")
    for i, g in enumerate(gcols):
        cond = cond & tagged[g].eqNullSafe(F.col(f"_k{i}"))
    out = tagged.join(right, cond, "inner").drop("_kc", *[f"_k{i}" for i in range(len(gcols))])
    out = out.withColumn(ordinal_col, (F.col("_offset") + F.col("_pos") - F.col("_start") + 1).cast("long"))
    return out.drop("_rid", "_chunk", "_pos", "_offset", "_start")


def top_k_per_group(df: DataFrame, group: str | Sequence[str], order: Sequence[Column], k: int,
                    rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..k within each group by ``order`` (include a unique
    tiebreak). Catalyst turns the ``row_number() <= k`` filter into a partial
    WindowGroupLimit before the shuffle, so each map task forwards at most k
    rows per group and a hot group cannot flood one reducer."""
    w = Window.partitionBy(*_cols(group)).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def global_top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Ordered limit (planned as TakeOrderedAndProject: per-partition top-k,
    then one merge of k rows per partition)."""
    return df.orderBy(*order).limit(k)
