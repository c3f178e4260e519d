"""Action-item centre: listing with meeting context, status updates (MUT1)
and the toggle rule (MUT2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dictionaries as DICT
from ..functions import classify as C


def action_centre(items: DataFrame, meetings: DataFrame, status: str | None = None) -> DataFrame:
    """ALG15 (JOI3, FIL14, SRT9): items with their meeting's title, optionally
    one status, by the meeting's start time descending (id breaks ties)."""
    j = items.join(meetings.select("meeting_id", F.col("title").alias("meeting_title"), "start_time"), "meeting_id")
    if status:
        j = j.filter(F.col("status") == status)
    return (j.orderBy(F.col("start_time").desc(), F.col("id"))
            .select("id", "meeting_id", "meeting_title", "task", "owner", "deadline", "status"))


def apply_status_updates(items: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """MUT1 for a batch of updates (id, status, seq).

    An update is rejected when its status is not Open/Closed/Blocked
    ('invalid status') or its id is unknown ('not found'), checked in that
    order. Per id the accepted update with the highest seq wins (``max_by``,
    partially aggregated, so a hot id does not gather in one task); other
    items keep their status. Returns (items, rejects).
    """
    valid_status = F.col("status").isin(*DICT.VALID_STATUSES)
    known = updates.join(items.select(F.col("id").alias("_known")), updates.id == F.col("_known"), "left")
    tagged = known.withColumn("reason", F.when(~valid_status | F.col("status").isNull(), F.lit("invalid status"))
                              .when(F.col("_known").isNull(), F.lit("not found")))
    rejects = tagged.filter(F.col("reason").isNotNull()).select("id", "status", "seq", "reason")
    latest = (tagged.filter(F.col("reason").isNull()).groupBy("id")
              .agg(F.max_by("status", "seq").alias("_new")))
    out = (items.join(latest, "id", "left")
           .withColumn("status", F.coalesce(F.col("_new"), F.col("status"))).drop("_new"))
    return out.select(*items.columns), rejects


def toggled(items: DataFrame) -> DataFrame:
    """MUT2: the status a click sets (Closed -> Open, else Closed)."""
    return items.withColumn("next_status", C.toggle_status("status"))
