"""Exact order statistics of huge groups without sorting them.

A wanted rank of a group lies in an open interval of values, at first the
whole line. Each round sketches the values inside (``percentile_approx``),
takes two of them as pivots around the wanted rank, counts exactly how many
values lie below, on, between and above, and narrows the interval. A pivot is
a value of the group, so an interval loses at least that value and the
result is exact whatever the sketch's error. Intervals of at most ``rows``
values are finished by running counts of their distinct values.

Sketches and counts combine map-side: a round shuffles one row per task and
interval, and a group holding most of the rows is no harder than others. A
round divides an interval by some ``PIECES / 3``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

PIECES = 256
FINISH_ROWS = 200_000


def _inside(values: DataFrame, brackets: DataFrame) -> DataFrame:
    """Values with each interval of their group that they lie in."""
    return values.join(brackets, F.col("_g").eqNullSafe(F.col("_k"))
                       & (F.col("_lo").isNull() | (F.col("_v") > F.col("_lo")))
                       & (F.col("_hi").isNull() | (F.col("_v") < F.col("_hi"))))


def _same_bracket(a: DataFrame, b: DataFrame) -> DataFrame:
    b = b.select(*[F.col(c).alias(f"{c}2") if c in ("_k", "_lo", "_hi") else F.col(c) for c in b.columns])
    return a.join(b, F.col("_k").eqNullSafe(F.col("_k2")) & F.col("_lo").eqNullSafe(F.col("_lo2"))
                  & F.col("_hi").eqNullSafe(F.col("_hi2"))).drop("_k2", "_lo2", "_hi2")


def _narrow(values: DataFrame, wide: DataFrame) -> DataFrame:
    """One round for the intervals of ``wide``."""
    points = [i / PIECES for i in range(PIECES + 1)]
    sketch = (_inside(values, wide.select("_k", "_lo", "_hi").distinct()).groupBy("_k", "_lo", "_hi")
              .agg(F.percentile_approx("_v", points, 20 * PIECES).alias("_s")))
    at = F.floor((F.col("_rank") - 1) / F.col("_size") * PIECES).cast("int")
    aimed = written(_same_bracket(wide, sketch).select(
        *wide.columns, F.get("_s", F.greatest(at - 1, F.lit(0))).alias("_a"),
        F.get("_s", F.least(at + 2, F.lit(PIECES))).alias("_b")))
    v, a, b = F.col("_v"), F.col("_a"), F.col("_b")
    counts = (_inside(values, aimed.select("_k", "_lo", "_hi", "_a", "_b").distinct())
              .groupBy("_k", "_lo", "_hi", "_a", "_b").agg(
        F.count_if(v < a).alias("_n0"), F.count_if(v <= a).alias("_n1"),
        F.count_if((v <= a) | (v < b)).alias("_n2"), F.count_if((v <= a) | (v <= b)).alias("_n3"))
        .withColumnsRenamed({"_a": "_a2", "_b": "_b2"}))
    out = _same_bracket(aimed, counts).where((a == F.col("_a2")) & (b == F.col("_b2")))
    rank, nothing = F.col("_rank"), F.lit(None)

    def by_place(below, on_a, between, on_b, above):
        return (F.when(rank <= F.col("_n0"), below).when(rank <= F.col("_n1"), on_a)
                .when(rank <= F.col("_n2"), between).when(rank <= F.col("_n3"), on_b).otherwise(above))

    zero = F.lit(0).cast("long")
    return out.select(
        "_k", "_tag",
        by_place(F.col("_lo"), nothing, a, nothing, b).alias("_lo"),
        by_place(a, nothing, b, nothing, F.col("_hi")).alias("_hi"),
        by_place(rank, rank, rank - F.col("_n1"), rank, rank - F.col("_n3")).alias("_rank"),
        by_place(F.col("_n0"), zero, F.col("_n2") - F.col("_n1"), zero, F.col("_size") - F.col("_n3")).alias("_size"),
        by_place(nothing, a, nothing, b, nothing).alias("_x"))


def values_at_ranks(df: DataFrame, group: str, value: str, wanted: DataFrame, rows: int = FINISH_ROWS) -> DataFrame:
    """``group, tag, x``: for each row ``(group, tag, rank, size)`` of
    ``wanted`` the value with that 1-based rank among the group's ``size``
    values that aren't NULL. A NULL group is a group; NaN ranks last."""
    values = df.select(F.col(group).alias("_g"), F.col(value).alias("_v")).where("_v IS NOT NULL")
    kind = values.schema["_v"].dataType
    state = written(wanted.select(
        F.col(group).alias("_k"), F.col("tag").alias("_tag"), F.lit(None).cast(kind).alias("_lo"), F.lit(None).cast(kind).alias("_hi"),
        F.col("rank").cast("long").alias("_rank"), F.col("size").cast("long").alias("_size"), F.lit(None).cast(kind).alias("_x")))
    while (state.agg(F.max("_size")).first()[0] or 0) > rows:
        state = written(_narrow(values, state.where(F.col("_size") > rows)).unionByName(state.where(F.col("_size") <= rows)))
    open_ = state.where("_size > 0")
    each = (_inside(values, open_.select("_k", "_lo", "_hi").distinct()).groupBy("_k", "_lo", "_hi", "_v")
            .agg(F.count(F.lit(1)).alias("_c")))
    upto = F.sum("_c").over(Window.partitionBy("_k", "_lo", "_hi").orderBy("_v"))  # at most `rows` values
    last = _same_bracket(open_, each.withColumn("_upto", upto)).where("_rank <= _upto AND _rank > _upto - _c")
    return (last.select("_k", "_tag", F.col("_v").alias("_x"))
            .unionByName(state.where("_size = 0").select("_k", "_tag", "_x"))
            .select(F.col("_k").alias(group), F.col("_tag").alias("tag"), F.col("_x").alias("x")))
