"""Queries over competitor/product mentions (binding B2 text -> B4), joined
to B3 meetings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import enrich as E
from ..operators.ordering import group_ordinals
from ..sources import bindings as B
from ..sources.tables import read_table
from . import sqltext as Q
from .registry import register


@register("enr15_16_turn_mentions", B.with_bindings("SELECT * FROM b4_mentions", "b4_mentions"))
def enr15_16_turn_mentions(spark, root):
    """ENR15 / ENR16 (JOI12): whole-word competitor and product mentions per
    speaker and meeting."""
    return B.b4_mentions(spark, root)


@register("enr17_entities", B.with_bindings("SELECT * FROM b4_entities", "b4_entities"))
def enr17_entities(spark, root):
    """ENR17 (SET4): distinct entities per meeting by type."""
    return B.b4_entities(spark, root)


@register("agg9_competitor_mentions", B.with_bindings("""
SELECT entity_name, count(*) AS count FROM b4_entities WHERE entity_type = 'Competitor'
GROUP BY entity_name ORDER BY count DESC, entity_name""", "b4_entities"))
def agg9_competitor_mentions(spark, root):
    """AGG9 (FIL17): meetings naming each competitor."""
    return A.mention_counts(B.b4_entities(spark, root), "Competitor")


@register("agg10_product_mentions", B.with_bindings("""
SELECT entity_name, count(*) AS count FROM b4_entities WHERE entity_type = 'Product'
GROUP BY entity_name ORDER BY count DESC, entity_name""", "b4_entities"))
def agg10_product_mentions(spark, root):
    """AGG10: meetings naming each product."""
    return A.mention_counts(B.b4_entities(spark, root), "Product")


@register("agg11_competitor_meetings", B.with_bindings("""
SELECT c.competitor, c.meeting_id, m.title, m.overall_sentiment AS sentiment, m.sentiment_score, m.call_type,
       m.start_time, n.mentions
FROM (SELECT entity_name AS competitor, meeting_id FROM b4_entities WHERE entity_type = 'Competitor') c
JOIN b3_meetings m ON c.meeting_id = m.meeting_id
JOIN (SELECT entity_name AS competitor, count(*) AS mentions FROM b4_entities WHERE entity_type = 'Competitor'
      GROUP BY entity_name) n ON n.competitor = c.competitor
ORDER BY n.mentions DESC, c.competitor, m.start_time DESC, c.meeting_id""", "b4_entities", "b3_meetings"))
def agg11_competitor_meetings(spark, root):
    """AGG11 (JOI2): every meeting naming each competitor, newest first."""
    return A.competitor_meetings(B.b4_entities(spark, root), B.b3_meetings(spark, root))


@register("fil17_product_entities", B.with_bindings(
    "SELECT meeting_id, entity_name FROM b4_entities WHERE entity_type = 'Product'", "b4_entities"))
def fil17_product_entities(spark, root):
    """FIL17: entity rows of one type."""
    return B.b4_entities(spark, root).filter(F.col("entity_type") == "Product").select("meeting_id", "entity_name")


ROLE_SQL = """
SELECT t.meeting_id, t.turn_index, t.speaker_name,
       CASE WHEN (x.email IS NOT NULL
                  AND (contains(lower(coalesce(t.speaker_name, '')), replace(lower(split_part(x.email, '@', 1)), '.', ' '))
                       OR contains(lower(split_part(x.email, '@', 1)), lower(coalesce(t.speaker_name, ''))))
                  AND contains(x.email, CASE WHEN contains(x.email, '@') THEN split_part(x.email, '@', 2) ELSE '' END))
                 OR contains(lower(coalesce(t.speaker_name, '')), 'system')
            THEN CASE x.call_type WHEN 'Support' THEN 'Support Agent' WHEN 'Internal' THEN 'Engineer' ELSE 'Account Manager' END
            WHEN x.call_type = 'Internal' THEN 'Engineer' ELSE 'Customer' END AS speaker_role
FROM b2_text t LEFT JOIN (
  SELECT i.meeting_id, a.email, m.call_type FROM (SELECT DISTINCT meeting_id FROM b2_text) i
  LEFT JOIN b9_addresses a ON a.meeting_id = i.meeting_id LEFT JOIN b3_meetings m ON m.meeting_id = i.meeting_id
) x ON x.meeting_id = t.meeting_id"""


@register("enr14_speaker_roles", B.with_bindings(ROLE_SQL, "b2_text", "b3_meetings", "b9_addresses"))
def enr14_speaker_roles(spark, root):
    """ENR14: speaker role per turn from addresses, host domain, staff hints
    and call type (evaluated once per meeting and speaker)."""
    turns = B.b2_text(spark, root).select("meeting_id", "turn_index", "speaker_name")
    ids = turns.select("meeting_id").distinct()
    mail = B.b9_addresses(spark, root).select("meeting_id", F.array("email").alias("all_emails"), F.col("email").alias("host"))
    meetings = (ids.join(mail, "meeting_id", "left")
                .join(B.b3_meetings(spark, root).select("meeting_id", "call_type"), "meeting_id", "left"))
    return E.speaker_roles(turns, meetings, "speaker_name", B.b9_dictionaries()).select(
        "meeting_id", "turn_index", "speaker_name", "speaker_role")


@register("joi12_dictionary_first_match", B.with_bindings(f"""
SELECT meeting_id, {Q.first_match('title', B.B3_ACCOUNTS)} AS account FROM b3_meetings""", "b3_meetings"))
def joi12_dictionary_first_match(spark, root):
    """JOI12 (ENR4): first dictionary term in the title through a
    size-checked broadcast nested-loop join and ``min_by`` on the rank."""
    dic = spark.createDataFrame([(t, i) for i, t in enumerate(B.B3_ACCOUNTS)], "term string, rank int")
    m = B.b3_meetings(spark, root).select("meeting_id", "title")
    return E.dictionary_first_match(m, "title", dic, ["meeting_id"], out="account").select("meeting_id", "account")


# the words of the conversations' first turns as a dictionary that grows with the data
WORDS_SQL = """
SELECT word AS term, CAST(row_number() OVER (ORDER BY n DESC, word) AS INTEGER) AS rank FROM (
  SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\\p{L}]+')) AS word FROM conversations WHERE turn = 0)
  WHERE length(word) > 3 GROUP BY word)"""


def _dictionary(spark, root):
    first = read_table(spark, root, "conversations").filter(F.col("turn") == 0)
    words = (first.select(F.explode(F.split(F.lower("text"), "[^\\p{L}]+")).alias("term")).filter(F.length("term") > 3)
             .groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    # ranks of the distinct words; the sort is global, as a list's order is
    ranked = group_ordinals(words.withColumn("_all", F.lit(0)), "_all", [F.col("n").desc(), "term"], ordinal_col="rank")
    return ranked.select("term", F.col("rank").cast("int").alias("rank"))


@register("joi12_large_dictionary", B.with_bindings("""
SELECT m.meeting_id, arg_min(w.term, w.rank) AS term FROM b6_meetings m LEFT JOIN words w ON contains(lower(m.title), w.term)
GROUP BY m.meeting_id""", "b6_meetings", extra={"words": WORDS_SQL}))
def joi12_large_dictionary(spark, root):
    """JOI12: first term of a dictionary that grows with the data in each
    title, looked up by anchors."""
    m = B.b6_meetings(spark, root).select("meeting_id", "title")
    return E.dictionary_first_match(m, "title", _dictionary(spark, root), ["meeting_id"], out="term").select("meeting_id", "term")


@register("enr15_large_dictionary", B.with_bindings("""
SELECT DISTINCT t.meeting_id, t.speaker_name, w.term AS entity_name, 'Word' AS entity_type
FROM (SELECT meeting_id, speaker_name, unnest(regexp_split_to_array(lower(sentence), '[^\\p{L}\\p{N}_]+')) AS word FROM b2_text) t
JOIN words w ON t.word = w.term""",
    "b2_text", extra={"words": WORDS_SQL}))
def enr15_large_dictionary(spark, root):
    """ENR15 (JOI12): whole-word mentions of a dictionary that grows with the data."""
    words = _dictionary(spark, root).select("term", F.col("term").alias("entity_name"), F.lit("Word").alias("entity_type"))
    return E.dictionary_mentions(B.b2_text(spark, root), words)
