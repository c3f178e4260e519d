"""Queries over topics (binding B5, with B3 meetings): issue and feature
lists, product priorities, topic x call-type counts and pivot, drill-down."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import analytics as A
from ..operators import filters as FL
from ..operators.ordering import top_k_per_group
from ..sources import bindings as B
from . import sqltext as Q
from .registry import register


def issues_sql(patterns) -> str:
    return (f"SELECT topic, count(*) AS count FROM b5_topics WHERE {Q.any_contains('topic', patterns)} "
            "GROUP BY topic ORDER BY count DESC, topic LIMIT 10")


ISSUES_SQL = issues_sql(B.B5_ISSUE_PATTERNS)
FEATURES_SQL = issues_sql(B.B5_FEATURE_PATTERNS)


def _issues(spark, root):
    return A.topics_matching(B.b5_topics(spark, root), B.B5_ISSUE_PATTERNS)


def _features(spark, root):
    return A.topics_matching(B.b5_topics(spark, root), B.B5_FEATURE_PATTERNS)


@register("agg6_issue_topics", B.with_bindings(ISSUES_SQL, "b5_topics"))
def agg6_issue_topics(spark, root):
    """AGG6 (FIL7): top 10 issue topics by meeting count."""
    return _issues(spark, root)


@register("agg7_feature_topics", B.with_bindings(FEATURES_SQL, "b5_topics"))
def agg7_feature_topics(spark, root):
    """AGG7 (FIL8): top 10 feature-request topics by meeting count."""
    return _features(spark, root)


PRIORITIES_SQL = """
SELECT name, type, volume, coalesce(max(volume) OVER (), 1) AS max_volume FROM (
  SELECT topic AS name, 'bug' AS type, count AS volume FROM issues
  UNION ALL SELECT topic, 'feature', count FROM features)"""


@register("alg5_product_priorities", B.with_bindings(PRIORITIES_SQL + " ORDER BY volume DESC, type, name", "b5_topics",
                                                     extra={"issues": ISSUES_SQL, "features": FEATURES_SQL}))
def alg5_product_priorities(spark, root):
    """ALG5 (SET3, AGG27, SRT10): issues and features in one list with the
    maximum volume for scaling."""
    return A.product_priorities(_issues(spark, root), _features(spark, root))


@register("fil15_priority_filter", B.with_bindings(
    "SELECT * FROM (" + PRIORITIES_SQL + ") WHERE type = 'feature' AND contains(lower(name), 'sign')",
    "b5_topics", extra={"issues": ISSUES_SQL, "features": FEATURES_SQL}))
def fil15_priority_filter(spark, root):
    """FIL15: priority list restricted to one tab and a name substring."""
    return A.product_priorities(_issues(spark, root), _features(spark, root), tab="feature", query="SIGN")


@register("fil7_8_topic_flags", B.with_bindings(f"""
SELECT meeting_id, topic, {Q.any_contains('topic', B.B5_ISSUE_PATTERNS)} AS is_issue,
       {Q.any_contains('topic', B.B5_FEATURE_PATTERNS)} AS is_feature FROM b5_topics""", "b5_topics"))
def fil7_8_topic_flags(spark, root):
    """FIL7 / FIL8: each topic row flagged as issue and/or feature (a topic
    may be both)."""
    t = B.b5_topics(spark, root)
    return t.select("meeting_id", "topic", X.contains_any("topic", B.B5_ISSUE_PATTERNS).alias("is_issue"),
                    X.contains_any("topic", B.B5_FEATURE_PATTERNS).alias("is_feature"))


TCT_SQL = """
SELECT t.topic, m.call_type, count(*) AS count FROM b5_topics t JOIN b3_meetings m ON t.meeting_id = m.meeting_id
GROUP BY t.topic, m.call_type"""


def _tct(spark, root):
    return A.topic_call_type_counts(B.b5_topics(spark, root), B.b3_meetings(spark, root))


@register("agg12_topic_call_type_counts", B.with_bindings(TCT_SQL, "b5_topics", "b3_meetings"))
def agg12_topic_call_type_counts(spark, root):
    """AGG12 (JOI1): topic rows per topic and call type."""
    return _tct(spark, root)


@register("agg13_topic_pivot", B.with_bindings("""
SELECT topic, Support, Internal, External, Support + Internal + External AS Total FROM (
  SELECT topic,
         CAST(coalesce(sum(count) FILTER (WHERE call_type = 'Support'), 0) AS BIGINT) AS Support,
         CAST(coalesce(sum(count) FILTER (WHERE call_type = 'Internal'), 0) AS BIGINT) AS Internal,
         CAST(coalesce(sum(count) FILTER (WHERE call_type = 'External'), 0) AS BIGINT) AS External
  FROM tct WHERE call_type IN ('Support', 'Internal', 'External') GROUP BY topic)
ORDER BY Total DESC, topic""", "b5_topics", "b3_meetings", extra={"tct": TCT_SQL}))
def agg13_topic_pivot(spark, root):
    """AGG13: topic x call type pivot with a Total column."""
    return A.topic_pivot(_tct(spark, root))


@register("agg14_topic_totals", B.with_bindings("""
SELECT topic, CAST(sum(count) AS BIGINT) AS count FROM tct GROUP BY topic ORDER BY count DESC, topic LIMIT 12""",
                                                "b5_topics", "b3_meetings", extra={"tct": TCT_SQL}))
def agg14_topic_totals(spark, root):
    """AGG14: the 12 most frequent topics over all call types."""
    return A.topic_totals(_tct(spark, root), 12)


# names spoken in the meetings stand for topics here, as titles and summaries hold them
SPOKEN = ("was", "with", "th")


@register("fil12_issue_drilldown", B.with_bindings("""
SELECT issue, meeting_id, title, start_time, rank FROM (
  SELECT i.topic AS issue, m.meeting_id, m.title, m.start_time,
         row_number() OVER (PARTITION BY i.topic ORDER BY m.start_time DESC, m.meeting_id) AS rank
  FROM b3_summaries m JOIN issues i
    ON contains(lower(m.title), lower(i.words)) OR contains(lower(coalesce(m.summary, '')), lower(i.words)))
WHERE rank <= 20""", "b4_entities", "b3_summaries", extra={"issues": f"""
SELECT entity_name AS topic, array_to_string(string_split(entity_name, ' ')[1:2], ' ') AS words
FROM b4_entities WHERE {Q.any_contains('entity_name', SPOKEN)} GROUP BY entity_name ORDER BY count(*) DESC, entity_name LIMIT 10"""}))
def fil12_issue_drilldown(spark, root):
    """FIL12: for each listed topic, up to 20 newest meetings whose title or
    summary contains the topic's first two words."""
    topics = A.topics_matching(B.b4_entities(spark, root).withColumnRenamed("entity_name", "topic"), SPOKEN)
    hits = FL.issue_meetings(topics, B.with_summary(spark, root, B.b3_meetings(spark, root)))
    return top_k_per_group(hits, "issue", [F.col("start_time").desc(), F.col("meeting_id")], 20).select(
        "issue", "meeting_id", "title", "start_time", F.col("rank").cast("long").alias("rank"))
