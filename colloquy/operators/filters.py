"""Meeting-list filters, paging and drill-downs (FIL1-FIL5, FIL10-FIL12,
FIL14, FIL16, SRT1, AGG28).

Every filter is a Column predicate on the scan, so Catalyst pushes the
equality parts into the Parquet reader; substring tests run inside the
scan's codegen stage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dictionaries as DICT
from .ordering import global_top_k


def like_pattern(needle: str) -> str:
    """Pattern for ``ilike`` in which a backslash stands for itself."""
    return "%" + needle.replace("\\", "\\\\") + "%"


def _ilike_contains(c: str, needle: str) -> Column:
    """``c ILIKE '%needle%'``: case-insensitive, and '%' / '_' inside the
    needle keep their wildcard meaning, as in the reference's SQL. A
    backslash is an ordinary character there, so it is doubled here."""
    return F.col(c).ilike(like_pattern(needle))


def meeting_filters(search: str | None = None, call_type: str | None = None,
                    sentiment: str | None = None, customer: str | None = None) -> Column:
    """FIL1-FIL5: conjunction of the optional filters; None or '' means not
    given. search matches title or summary, customer matches the title."""
    conds = [F.lit(True)]
    if search:
        conds.append(_ilike_contains("title", search) | _ilike_contains("summary", search))
    if call_type:
        conds.append(F.col("call_type") == call_type)
    if sentiment:
        conds.append(F.col("overall_sentiment") == sentiment)
    if customer:
        conds.append(_ilike_contains("title", customer))
    return reduce(lambda a, b: a & b, conds)


def list_meetings(meetings: DataFrame, limit: int = DICT.PAGE_SIZE, offset: int = 0, **filters) -> DataFrame:
    """SRT1: filtered meetings, newest first (meeting_id breaks ties), one
    page of ``limit`` rows after ``offset``."""
    f = meetings.filter(meeting_filters(**filters))
    return global_top_k(f, [F.col("start_time").desc(), F.col("meeting_id")], offset + limit).offset(offset) \
        if offset else global_top_k(f, [F.col("start_time").desc(), F.col("meeting_id")], limit)


def count_meetings(meetings: DataFrame, **filters) -> DataFrame:
    """AGG28: total of the filtered list before paging (no sort needed)."""
    return meetings.filter(meeting_filters(**filters)).agg(F.count(F.lit(1)).alias("total"))


def page_offset(page: int, page_size: int = DICT.PAGE_SIZE) -> int:
    """Page number (1-based) to row offset."""
    return max(page - 1, 0) * page_size


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """FIL10: rows whose key equals ``value`` (empty when absent)."""
    return df.filter(F.col(key) == F.lit(value))


def on_date(meetings: DataFrame, day: str) -> DataFrame:
    """FIL11: meetings that start on the given calendar day."""
    return meetings.filter(F.to_date("start_time") == F.to_date(F.lit(day)))


def issue_meetings(issues: DataFrame, meetings: DataFrame) -> DataFrame:
    """FIL12: for each issue, the meetings whose title or summary contains
    its first two words ('%' and '_' keep their wildcard meaning, a backslash
    stands for itself). The issue list is a top-k result (bounded), so it is
    broadcast into one nested-loop join over the meetings scan."""
    q = issues.select(F.col("topic").alias("issue"),
                      F.replace(F.substring_index(F.col("topic"), " ", 2), F.lit("\\"), F.lit("\\\\")).alias("_q"))
    pattern = F.concat(F.lit("%"), F.col("_q"), F.lit("%"))
    cond = F.ilike(F.col("title"), pattern) | F.ilike(F.coalesce(F.col("summary"), F.lit("")), pattern)
    return (meetings.join(F.broadcast(q), cond)
            .select("issue", "meeting_id", "title", "start_time"))


def by_status(items: DataFrame, status: str | None) -> DataFrame:
    """FIL14: action items with the given status (all when None)."""
    return items if not status else items.filter(F.col("status") == status)


def pending_count(items: DataFrame) -> DataFrame:
    """FIL16: number of items whose status is not Closed."""
    return items.agg(F.count_if(F.col("status") != "Closed").alias("pending"))
