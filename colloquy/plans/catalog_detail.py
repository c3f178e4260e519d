"""Meeting detail, dashboard bundle and table audits over the bindings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import enrich as E
from ..operators import sinks as SK
from ..sources import bindings as B
from ..sources.tables import read_table, tasks_for
from . import detail as DT
from .catalog_actions import ITEMS_SQL
from .catalog_meetings import ACCOUNT_SQL, TIMELINE_SQL
from .catalog_topics import FEATURES_SQL, ISSUES_SQL
from . import sqltext as Q
from .registry import register


def b2_moments(spark, root):
    """Turns as key moments, timed against their order."""
    return B.b2_text(spark, root).select(
        F.concat(F.col("meeting_id").cast("string"), F.lit("_km_"), F.col("turn_index").cast("string")).alias("id"), "meeting_id",
        (-F.col("turn_index")).cast("double").alias("time"), F.col("sentence").alias("text"), F.lit("said").alias("type"),
        F.col("speaker_name").alias("speaker"))


def _detail(spark, root, meeting_id=None):
    return DT.meeting_detail(
        B.with_summary(spark, root, B.b3_meetings(spark, root)), segments=B.b1_segments(spark, root, meeting_id=meeting_id),
        action_items=E.action_items(B.b8_items(spark, root), "meeting_id", "pos", "item"),
        topics=B.b5_topics(spark, root), key_moments=b2_moments(spark, root), entities=B.b4_entities(spark, root),
        meeting_id=meeting_id)


def detail_sql(where: str = "") -> str:
    """Sections are stacked by name, so each lists only what it has."""
    first = ("SELECT meeting_id, 'meeting' AS section, 0 AS section_order, CAST(0 AS BIGINT) AS pos, title AS name, CAST(NULL AS VARCHAR) AS text, "
             "call_type AS kind, overall_sentiment AS extra, sentiment_score AS time, CAST(NULL AS VARCHAR) AS id, "
             "CAST(NULL AS VARCHAR) AS organizer_email, CAST(NULL AS VARCHAR) AS host, start_time, end_time, duration, summary, "
             "CAST(NULL AS DOUBLE) AS until, CAST(NULL AS DOUBLE) AS confidence FROM b3_summaries")
    return B.with_bindings(f"""
SELECT * FROM (
  {first}
  UNION ALL BY NAME SELECT meeting_id, 'transcript' AS section, 1 AS section_order, CAST(turn_index AS BIGINT) AS pos, speaker_name AS name,
         sentence AS text, sentiment_type AS kind, speaker_role AS extra, id FROM b1_segments
  UNION ALL BY NAME SELECT meeting_id, 'action_items' AS section, 2 AS section_order,
         TRY_CAST(regexp_extract(id, '_ai_(\\d+)$', 1) AS BIGINT) AS pos, owner AS name, task AS text, status AS kind, deadline AS extra, id FROM items
  UNION ALL BY NAME SELECT meeting_id, 'topics' AS section, 3 AS section_order, CAST(0 AS BIGINT) AS pos, topic AS text FROM b5_topics
  UNION ALL BY NAME SELECT meeting_id, 'key_moments' AS section, 4 AS section_order, CAST(turn_index AS BIGINT) AS pos, speaker_name AS name,
         sentence AS text, 'said' AS kind, CAST(-turn_index AS DOUBLE) AS time, concat(meeting_id, '_km_', turn_index) AS id FROM b2_text
  UNION ALL BY NAME SELECT meeting_id, 'entities' AS section, 5 AS section_order, CAST(0 AS BIGINT) AS pos, entity_name AS name, entity_type AS kind FROM b4_entities
) d WHERE meeting_id IN (SELECT meeting_id FROM b3_meetings {where})
ORDER BY meeting_id, section_order, CASE WHEN section = 'key_moments' THEN time END, pos""", "b1_segments", "b2_text", "b3_summaries", "b4_entities", "b5_topics",
                           "b8_items", extra={"items": ITEMS_SQL})


@register("alg10_meeting_detail", detail_sql())
def alg10_meeting_detail(spark, root):
    """ALG10 (JOI13, SRT6): header and child sections of every meeting,
    flat and ordered."""
    return _detail(spark, root)


@register("alg10_meeting_detail_one", detail_sql("WHERE meeting_id = 7"))
def alg10_meeting_detail_one(spark, root):
    """ALG10 + FIL10: the detail of one meeting."""
    return _detail(spark, root, meeting_id=7)


def _dash_sql() -> str:
    m = "SELECT * FROM b3_meetings"
    return B.with_bindings(f"""
SELECT 'kpis' AS section, 'total_meetings' AS item, CAST(count(*) AS DOUBLE) AS value, CAST(NULL AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS label, CAST(NULL AS BIGINT) AS support_calls FROM m
UNION ALL SELECT 'kpis', 'average_sentiment', {Q.round_fixed('avg(sentiment_score)', 2)}, NULL, NULL, NULL FROM m
UNION ALL SELECT 'kpis', 'total_hours', {Q.round_fixed('sum(duration) / CAST(60.0 AS DOUBLE)', 1)}, NULL, NULL, NULL FROM m
UNION ALL SELECT 'call_type', call_type, NULL, count(*), NULL, NULL FROM m GROUP BY call_type
UNION ALL SELECT 'sentiment', overall_sentiment, NULL, count(*), NULL, NULL FROM m GROUP BY overall_sentiment
UNION ALL SELECT 'customer_risk', customer, avg_sentiment, total_calls, risk, support_calls FROM (
  SELECT * FROM accounts ORDER BY CASE risk WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 WHEN 'Low' THEN 2 ELSE 3 END,
  avg_sentiment, customer LIMIT 12)
UNION ALL SELECT 'product_risk', topic, NULL, count, NULL, NULL FROM issues
UNION ALL SELECT 'feature_requests', topic, NULL, count, NULL, NULL FROM features
UNION ALL SELECT 'timeline', date, sentiment, count, NULL, NULL FROM timeline""",
                           "b3_meetings", "b5_topics",
                           extra={"m": m, "accounts": ACCOUNT_SQL, "issues": ISSUES_SQL, "features": FEATURES_SQL,
                                  "timeline": TIMELINE_SQL})


@register("alg14_dashboard", _dash_sql())
def alg14_dashboard(spark, root):
    """ALG14: the dashboard bundle as one tagged table."""
    m = B.b3_meetings(spark, root)
    d = B.b3_dictionaries().with_(issue_patterns=B.B5_ISSUE_PATTERNS, feature_patterns=B.B5_FEATURE_PATTERNS)
    return DT.dashboard(m, B.b5_topics(spark, root), d)


AUDIT = ("b1_segments", "b2_text", "b3_meetings", "b4_entities", "b5_topics", "b6_lines", "b7_nodes", "b7_edges",
         "b8_items", "b9_addresses")


@register("snk6_row_count_audit", B.with_bindings(
    " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in AUDIT), *AUDIT))
def snk6_row_count_audit(spark, root):
    """SNK6: row count of every bound table."""
    return SK.row_counts({t: B.b1_segments(spark, root, ordered=False) if t == "b1_segments" else getattr(B, t)(spark, root) for t in AUDIT})


RAW_TOPICS_SQL = "SELECT user_id AS meeting_id, concat(event_type, ' ', regexp_extract(props, '[0-9]+', 0)) AS topic FROM events"


def raw_topics(spark, root):
    """Topic rows as they come, with repeats."""
    ev = read_table(spark, root, "events")
    return ev.select(F.col("user_id").alias("meeting_id"),
                     F.concat(F.col("event_type"), F.lit(" "), F.regexp_extract("props", "[0-9]+", 0)).alias("topic"))


# the raw topics repeat their key, the others have none that repeats
KEYS = {"b1_segments": ("id",), "raw_topics": ("meeting_id", "topic"), "b3_meetings": ("meeting_id",),
        "b4_entities": ("meeting_id", "entity_name", "entity_type"),
        "b5_topics": ("meeting_id", "topic"), "b7_nodes": ("id",), "b7_edges": ("source", "target", "relation")}


@register("snk3_key_violations", B.with_bindings(" UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", CAST(count(*) AS BIGINT) AS rows FROM {t} GROUP BY {', '.join(k)} "
    f"HAVING count(*) > 1 OR bool_or({' OR '.join(c + ' IS NULL' for c in k)})" for t, k in KEYS.items()),
    *[t for t in KEYS if t != "raw_topics"], extra={"raw_topics": RAW_TOPICS_SQL}))
def snk3_key_violations(spark, root):
    """SNK3: duplicate or NULL keys, in the bound tables (none) and in topic
    rows with repeats."""
    out = None
    # the largest tables: as many keys as rows, or nearly
    rows = {"b1_segments": "events", "b7_edges": "lineitem"}
    for t, k in KEYS.items():
        df = raw_topics(spark, root) if t == "raw_topics" else getattr(B, t)(spark, root)
        tasks = tasks_for(read_table(spark, root, rows[t]).count()) if t in rows else None
        v = SK.key_violations(df, k, tasks).select(F.lit(t).alias("table"), "rows")
        out = v if out is None else out.unionByName(v)
    return out


@register("snk4_insert_ignore", B.with_bindings(f"SELECT DISTINCT meeting_id, topic FROM ({RAW_TOPICS_SQL})"))
def snk4_insert_ignore(spark, root):
    """SNK4: topic rows with repeats, inserted ignoring key conflicts."""
    return SK.insert_ignore(raw_topics(spark, root), ["meeting_id", "topic"])


@register("snk7_sample", B.with_bindings(
    "SELECT meeting_id, title, call_type FROM b3_meetings ORDER BY meeting_id LIMIT 5", "b3_meetings"))
def snk7_sample(spark, root):
    """SNK7: the first five meetings (fixed order)."""
    return SK.sample(B.b3_meetings(spark, root), ["meeting_id"], 5, ["meeting_id", "title", "call_type"])
