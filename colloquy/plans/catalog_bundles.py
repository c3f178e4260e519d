"""Queries of the bundle reader: documents of the driver's table written as
the six JSON documents of a meeting (binding B10), read, gated and flattened
by the ingestion's own steps.

Among them are folders without any file, missing and undecodable documents,
``NaN`` numbers, empty times and absent keys; which document has what follows
from its id, and the reader knows nothing of that."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dictionaries as DICT
from .. import schemas as S
from ..operators import sinks as SK
from ..session import checkpoint_dir
from ..sources import bundles as BN
from ..sources.tables import read_table
from . import ingest as ING
from . import sqltext as Q
from .registry import register


def b10_files(spark, root) -> tuple[DataFrame, DataFrame]:
    """(folder, file, text) of the bundle documents and (folder) of all folders."""
    i, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    docs = read_table(spark, root, "documents").select(
        "doc_id", "lang", "source", "n_chars", text.alias("text"), F.split(text, "\n").alias("lines"),
        F.concat(F.lit("m"), i.cast("string")).alias("folder"))
    mail = F.concat(F.lit("lead@"), F.col("lang"), F.lit(".io"))
    day = lambda hour: F.when(i % 5 == 0, F.lit("")).otherwise(
        F.concat(F.lit("2026-02-"), F.lpad((i % 28 + 1).cast("string"), 2, "0"), F.lit(f"T{hour}.000Z")))
    info = F.to_json(F.struct(
        F.concat(F.lit("d"), i.cast("string")).alias("meetingId"),
        F.when(i % 7 != 3, F.get("lines", F.lit(0))).alias("title"), mail.alias("organizerEmail"), mail.alias("host"),
        day("09:15:00").alias("startTime"), day("10:00:30").alias("endTime"),
        F.when(i % 11 == 5, F.lit(-1)).otherwise(F.col("n_chars")).alias("duration"), F.array(mail).alias("allEmails"),
        F.when(i % 3 == 0, F.array("lang")).otherwise(F.array("lang", "source")).alias("invitees")))
    at = lambda p: p.cast("long")
    summary = F.to_json(F.struct(
        F.col("text").alias("summary"), F.col("source").alias("overallSentiment"), (i % 10 / 2).alias("sentimentScore"),
        F.array(F.concat("source", F.lit(": "), F.get("lines", F.lit(0)), F.lit(" by Friday")), F.col("text")).alias("actionItems"),
        F.array("lang", "source", "lang").alias("topics"),
        F.transform("lines", lambda x, p: F.struct(at(p).alias("time"), x.alias("text"), F.lit("line").alias("type"),
                                                   F.col("source").alias("speaker"))).alias("keyMoments")))
    transcript = F.to_json(F.struct(F.transform("lines", lambda x, p: F.struct(
        F.when(x != "", x).alias("sentence"), F.when(p % 4 != 3, F.concat(F.lit("sp"), (p % 3).cast("string"))).alias("speaker_name"),
        F.lit("neutral").alias("sentimentType"), at(p).alias("time"), (p + F.lit(0.5)).cast("double").alias("endTime"),
        F.lit(0.9).alias("averageConfidence"), (at(p) * 2).alias("index"))).alias("data")))
    meta = F.to_json(F.struct(F.lit("sp0").alias("0"), F.lit("sp1").alias("1"), F.col("source").alias("2")))
    texts = {"summary.json": F.when(i % 10 != 9, summary), "meeting-info.json": F.regexp_replace(info, '"duration":-1', '"duration":NaN'),
             "speakers.json": F.lit("[]"), "events.json": F.when(i % 13 == 6, '[{"type": "Join",').otherwise("[]"),
             "speaker-meta.json": meta, "transcript.json": F.when(i % 9 != 4, transcript)}
    files = docs.filter(i % 17 != 2).select("folder", F.explode(F.array(*[
        F.struct(F.lit(name).alias("file"), t.alias("text")) for name, t in texts.items()])).alias("f"))
    return files.select("folder", "f.file", "f.text").filter(F.col("text").isNotNull()), docs.select("folder")


def _staged(spark, root) -> tuple[BN.Bundles, DataFrame]:
    """The staged documents and the gate's verdict per folder."""
    rows, folders = b10_files(spark, root)
    files = BN.parse_files(rows, f"{checkpoint_dir(spark)}/bundles-{uuid.uuid4()}")
    return BN.Bundles(files, folders=folders), BN.gate(files, folders=folders)


def _accepted(spark, root) -> BN.Bundles:
    return BN.accepted(*_staged(spark, root))


def _ids(bundles: BN.Bundles) -> DataFrame:
    return ING.meetings_table(bundles).select("folder", "meeting_id")


STATUS = """
SELECT *, concat('m', doc_id) AS folder, concat('d', doc_id) AS meeting_id, string_split(coalesce(text, ''), chr(10)) AS lines,
       CASE WHEN doc_id % 17 = 2 OR doc_id % 10 = 9 THEN 'summary.json' WHEN doc_id % 9 = 4 THEN 'transcript.json' END AS absent,
       doc_id % 13 = 6 AS broken
FROM documents"""
OK = "SELECT * FROM b10 WHERE absent IS NULL AND NOT broken"


def sql(body: str) -> str:
    return f"WITH b10 AS ({STATUS.strip()}),\nok AS ({OK})\n{body.strip()}"


REJECTS_SQL = """
SELECT folder, CASE WHEN absent IS NOT NULL THEN 'missing' ELSE 'undecodable' END AS reason,
       CASE WHEN absent IS NOT NULL THEN concat('Missing file ', absent, ' in ', folder) ELSE concat('JSON Decode Error in ', folder) END AS detail
FROM b10 WHERE absent IS NOT NULL OR broken"""


@register("src4_6_rejects", sql(REJECTS_SQL))
def src4_6_rejects(spark, root):
    """SRC1, SRC4-SRC6: rejected folders with the first missing file or the
    decode error; folders without any file are among them."""
    return BN.rejects(_staged(spark, root)[1])


@register("src6_report", sql("""
SELECT count(*) FILTER (WHERE absent IS NULL AND NOT broken) AS processed,
       count(*) FILTER (WHERE absent IS NOT NULL OR broken) AS rejected FROM b10"""))
def src6_report(spark, root):
    """SRC6: processed and rejected folder counts."""
    return BN.report(_staged(spark, root)[1])


@register("src6_first_rejects", sql(f"SELECT folder, detail FROM ({REJECTS_SQL}) ORDER BY folder LIMIT 5"))
def src6_first_rejects(spark, root):
    """SRC6: the first five reject messages."""
    return BN.first_rejects(_staged(spark, root)[1])


TITLE = "CASE WHEN doc_id % 7 = 3 THEN 'Untitled Meeting' ELSE lines[1] END"
CALL_TYPE = (f"CASE WHEN {Q.any_contains('lower(title)', DICT.SUPPORT_TITLE_KEYWORDS)} THEN 'Support' "
             f"WHEN {Q.any_contains('lower(title)', DICT.INTERNAL_TITLE_KEYWORDS)} OR doc_id % 3 = 0 THEN 'Internal' ELSE 'External' END")


def _time(hour: str) -> str:
    return (f"CASE WHEN doc_id % 5 <> 0 THEN CAST(concat('2026-02-', lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0'), ' {hour}') "
            "AS TIMESTAMP) END")


@register("src5_meetings", sql(f"""
SELECT meeting_id, title, organizer_email, organizer_email AS host, start_time, end_time, duration, text AS summary,
       source AS overall_sentiment, CAST(doc_id % 10 AS DOUBLE) / 2 AS sentiment_score, {CALL_TYPE} AS call_type
FROM (SELECT doc_id, meeting_id, {TITLE} AS title, concat('lead@', lang, '.io') AS organizer_email, {_time('09:15:00')} AS start_time,
             {_time('10:00:30')} AS end_time, CASE WHEN doc_id % 11 = 5 THEN CAST('NaN' AS DOUBLE) ELSE CAST(n_chars AS DOUBLE) END AS duration,
             coalesce(text, '') AS text, source FROM ok)"""))
def src5_meetings(spark, root):
    """SRC1, SRC5, ENR1, ENR2, SNK2: the meetings table of the accepted
    folders (times, defaults of absent keys, NaN durations, declared types)."""
    return SK.align(ING.meetings_table(_accepted(spark, root)), S.MEETINGS)


@register("enr13_turns", sql("""
SELECT concat(meeting_id, '_t_', p) AS id, meeting_id, lines[p + 1] AS sentence,
       CASE WHEN p % 4 = 3 THEN 'Unknown' ELSE concat('sp', p % 3) END AS speaker_name, 'neutral' AS sentiment_type,
       CAST(p AS DOUBLE) AS time, p + CAST(0.5 AS DOUBLE) AS end_time, CAST(0.9 AS DOUBLE) AS average_confidence, CAST(p * 2 AS INTEGER) AS turn_index
FROM (SELECT meeting_id, lines, unnest(range(0, len(lines))) AS p FROM ok)"""))
def enr13_turns(spark, root):
    """ENR13, ENR9 (_t_), ENR2: transcript turns with the index of the record
    and an id by position; absent sentence and speaker get their defaults."""
    b = _accepted(spark, root)
    return ING.transcript_turns(b, _ids(b)).drop("pos")


@register("enr12_key_moments", sql("""
SELECT concat(meeting_id, '_km_', p) AS id, meeting_id, CAST(p AS DOUBLE) AS time, lines[p + 1] AS text, 'line' AS type, source AS speaker
FROM (SELECT meeting_id, lines, source, unnest(range(0, len(lines))) AS p FROM ok)"""))
def enr12_key_moments(spark, root):
    """ENR12, ENR9 (_km_): key moments."""
    b = _accepted(spark, root)
    return SK.align(ING.summary_children(b, _ids(b))[2], S.KEY_MOMENTS)


@register("enr11_topics", sql("SELECT meeting_id, lang AS topic FROM ok UNION SELECT meeting_id, source FROM ok"))
def enr11_topics(spark, root):
    """ENR11: topics, each once per meeting."""
    b = _accepted(spark, root)
    return SK.align(ING.summary_children(b, _ids(b))[1], S.TOPICS)


@register("src2_speaker_meta", sql("SELECT meeting_id, unnest(['sp0', 'sp1', source]) AS speaker FROM ok"))
def src2_speaker_meta(spark, root):
    """SRC2, SCA20: the values of an object with dynamic keys."""
    b = _accepted(spark, root)
    return ING.speaker_meta(b, _ids(b))
