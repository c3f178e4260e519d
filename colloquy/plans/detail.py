"""Meeting detail (ALG10, JOI13, SRT6) and the dashboard bundle (ALG14).

The detail of a meeting is returned flat: one row per element, tagged with
its section and ordered by (meeting, section, position). A nested record
per meeting would gather a whole transcript into one row, which a very long
meeting cannot afford; the flat form carries the same content and a
point lookup pushes the meeting filter into every section's scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dictionaries import DEFAULT, Dictionaries
from ..functions import classify as C
from ..operators import analytics as A
from ..session import written

SECTIONS = ("meeting", "transcript", "action_items", "topics", "key_moments", "entities")
# columns of one section or two; NULL in the others
MORE = {"id": "string", "organizer_email": "string", "host": "string", "start_time": "timestamp_ntz",
        "end_time": "timestamp_ntz", "duration": "double", "summary": "string", "until": "double", "confidence": "double"}
DETAIL_COLUMNS = ("meeting_id", "section", "section_order", "pos", "name", "text", "kind", "extra", "time", *MORE)


def _row(df: DataFrame, section: str, pos, name, text, kind, extra, time, **more: str) -> DataFrame:
    def c(x, t="string"):
        if x is None or isinstance(x, str) and x not in df.columns:
            return F.lit(None).cast(t)
        return (F.col(x) if isinstance(x, str) else x).cast(t)
    return df.select("meeting_id", F.lit(section).alias("section"), F.lit(SECTIONS.index(section)).alias("section_order"),
                     c(pos, "long").alias("pos"), c(name).alias("name"), c(text).alias("text"), c(kind).alias("kind"),
                     c(extra).alias("extra"), c(time, "double").alias("time"),
                     *[c(more.get(k), t).alias(k) for k, t in MORE.items()])


def meeting_detail(meetings: DataFrame, segments: DataFrame | None = None, action_items: DataFrame | None = None,
                   topics: DataFrame | None = None, key_moments: DataFrame | None = None,
                   entities: DataFrame | None = None, meeting_id=None) -> DataFrame:
    """Header plus every child section of each meeting (or of one meeting).

    meeting     name=title, kind=call_type, extra=overall_sentiment, time=score,
                organizer_email, host, start_time, end_time, duration, summary
    transcript  id, pos=turn_index, name=speaker, text=sentence, kind=sentiment, extra=role, time,
                until=end time, confidence
    action      id, pos=item position, name=owner, text=task, kind=status, extra=deadline
    topics      text=topic
    key_moments id, pos=position, name=speaker, text=text, kind=type, time
    entities    name=entity_name, kind=entity_type
    Children of meetings that do not exist are left out (inner semantics).
    """
    if meeting_id is not None:
        # each section is filtered by itself, so the filter reaches its scan
        meetings, segments, action_items, topics, key_moments, entities = [
            df if df is None else df.filter(F.col("meeting_id") == F.lit(meeting_id))
            for df in (meetings, segments, action_items, topics, key_moments, entities)]
    parts = [_row(meetings, "meeting", F.lit(0), "title", None, "call_type", "overall_sentiment", "sentiment_score",
                  organizer_email="organizer_email", host="host", start_time="start_time", end_time="end_time",
                  duration="duration", summary="summary")]
    if segments is not None:
        parts.append(_row(segments, "transcript", "turn_index", "speaker_name", "sentence", "sentiment_type",
                          "speaker_role", "time", id="id", until="end_time", confidence="average_confidence"))
    if action_items is not None:
        pos = F.regexp_extract("id", r"_ai_(\d+)$", 1).try_cast("long")
        parts.append(_row(action_items, "action_items", pos, "owner", "task", "status", "deadline", None, id="id"))
    if topics is not None:
        parts.append(_row(topics, "topics", F.lit(0), None, "topic", None, None, None))
    if key_moments is not None:
        pos = F.regexp_extract("id", r"_km_(\d+)$", 1).try_cast("long")
        parts.append(_row(key_moments, "key_moments", pos, "speaker", "text", "type", None, "time", id="id"))
    if entities is not None:
        parts.append(_row(entities, "entities", F.lit(0), "entity_name", None, "entity_type", None, None))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    known = meetings.select("meeting_id")
    return (out.join(known, "meeting_id", "left_semi")
            # key moments go by their time, the other sections by position
            .orderBy("meeting_id", "section_order", F.when(F.col("section") == "key_moments", F.col("time")), "pos"))


def dashboard(meetings: DataFrame, topics: DataFrame, d: Dictionaries = DEFAULT) -> DataFrame:
    """ALG14: KPIs, call-type and sentiment breakdowns, account risk (top
    12), issue and feature lists and the timeline as one tagged table
    (section, item, value, n, label, support_calls). Meetings and topics are
    each read and aggregated once; the parts are made from the groups, which
    are written to the checkpoint folder at once."""
    def rows(df, section, item, value=None, n=None, label=None, support_calls=None):
        def c(x, t):
            return F.lit(None).cast(t) if x is None else (F.col(x) if isinstance(x, str) else x).cast(t)
        return df.select((F.lit(section) if isinstance(section, str) else section).alias("section"), c(item, "string").alias("item"), c(value, "double").alias("value"),
                         c(n, "long").alias("n"), c(label, "string").alias("label"),
                         c(support_calls, "long").alias("support_calls"))

    groups = written(A.meeting_groups(meetings, d))

    def of(part, *names):
        return groups.where(F.col("part") == part).select(*names)

    # a total over no meetings is still a row
    total = of("all", "count", "_avg", "minutes").agg(
        F.coalesce(F.max("count"), F.lit(0)).alias("total_meetings"), C.fixed_round(F.max("_avg"), 2).alias("average_sentiment"),
        C.fixed_round(F.max("minutes") / F.lit(60.0), 1).alias("total_hours"))
    k = total.select(F.explode(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("value"))
                                         for c in total.columns])).alias("k"))
    accounts = of("customer", "customer", "_avg", "support_calls", F.col("count").alias("total_calls")).where("customer IS NOT NULL")
    by_topic = A.topics_by_section(topics, {"product_risk": d.issue_patterns, "feature_requests": d.feature_patterns})
    parts = [
        rows(k, "kpis", "k.item", "k.value"),
        rows(of("call_type", "call_type", "count"), "call_type", "call_type", n="count"),
        rows(of("sentiment", "sentiment", "count"), "sentiment", "sentiment", n="count"),
        rows(A.account_risk_top(A.account_report(accounts)), "customer_risk", "customer", "avg_sentiment",
             "total_calls", "risk", "support_calls"),
        rows(by_topic, F.col("section"), "topic", n="count"),
        rows(A.last_days(of("day", F.col("day").alias("date"), "_avg", "count")), "timeline", "date", "sentiment", "count"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
