"""Ingestion job: meeting bundles -> gates -> enrichment -> eight tables.

Stages:
 1. stage   all bundle files, parsed once, compacted to Parquet (SRC1)
 2. gate    completeness and decode checks per folder (SRC4, SRC5, SRC6)
 3. enrich  meetings, segments, action items, topics, key moments,
            entities (ENR1-ENR18), each a projection of the staged rows
 4. graph   nodes (last writer wins) and edges (GRB1-GRB9)
 5. write   key checks and a full refresh of all tables at once (SNK1-SNK4)

Shuffles: the folder join of meeting-info and summary, the speaker-role
join, mention de-duplication and the node upsert; everything else is a
narrow projection of the staged rows.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..dictionaries import DEFAULT, Dictionaries
from ..functions import classify as C
from ..functions import text as X
from ..operators import enrich as E
from ..operators import graph as G
from ..operators import sinks as SK
from ..operators import stored as ST
from ..sources import bundles as BN


# action items are updated in place, by id
KEYED = {"action_items": ("id", 64)}


@dataclass
class Ingested:
    tables: dict[str, DataFrame]
    status: DataFrame       # folder, reason, detail (reason NULL = accepted)
    rejects: DataFrame
    report: DataFrame


def _doc_of(bundles: BN.Bundles, name: str) -> DataFrame:
    return bundles.files.filter(F.col("file") == name).select("folder", "doc")


def meetings_table(bundles: BN.Bundles, d: Dictionaries = DEFAULT) -> DataFrame:
    """meetings plus the working columns the later steps need (all_emails,
    invitees count, account)."""
    info = _doc_of(bundles, "meeting-info.json").select(
        "folder",
        BN.field("doc", "$.meetingId", "string").alias("meeting_id"),
        BN.field("doc", "$.title", "string", F.lit("Untitled Meeting")).alias("title"),
        BN.field("doc", "$.organizerEmail", "string").alias("organizer_email"),
        BN.field("doc", "$.host", "string").alias("host"),
        X.iso_to_timestamp(BN.field("doc", "$.startTime", "string")).alias("start_time"),
        X.iso_to_timestamp(BN.field("doc", "$.endTime", "string")).alias("end_time"),
        BN.field("doc", "$.duration", "double").alias("duration"),
        F.coalesce(BN.field("doc", "$.allEmails", "array<string>"), F.array().cast("array<string>")).alias("all_emails"),
        F.size(BN.field("doc", "$.invitees", "array<string>")).alias("_invitees"))
    summ = _doc_of(bundles, "summary.json").select(
        "folder",
        BN.field("doc", "$.summary", "string").alias("summary"),
        BN.field("doc", "$.overallSentiment", "string").alias("overall_sentiment"),
        BN.field("doc", "$.sentimentScore", "double").alias("sentiment_score"))
    m = info.join(summ, "folder")
    m = m.withColumn("call_type", C.call_type("title", F.when(F.col("_invitees") >= 0, F.col("_invitees")), d))
    return m.withColumn("account", C.resolve_account(F.coalesce("title", F.lit("")), "all_emails", d))


def summary_children(bundles: BN.Bundles, ids: DataFrame, d: Dictionaries = DEFAULT):
    """Action items, topics and key moments exploded from summary.json."""
    def children(key: str) -> DataFrame:
        return BN.exploded(bundles, "summary.json", key).join(ids, "folder")

    raw_items = children("actionItems").select("meeting_id", "pos", F.try_variant_get("value", "$", "string").alias("item"))
    items = E.action_items(raw_items, "meeting_id", "pos", "item", d, keep_pos=True)
    topics_pos = (children("topics").select("meeting_id", "pos", F.try_variant_get("value", "$", "string").alias("topic"))
                  .groupBy("meeting_id", "topic").agg(F.min("pos").alias("pos")))
    moments = children("keyMoments").select(
        F.concat("meeting_id", F.lit("_km_"), F.col("pos").cast("string")).alias("id"), "meeting_id",
        BN.field("value", "$.time", "double").alias("time"), BN.field("value", "$.text", "string").alias("text"),
        BN.field("value", "$.type", "string").alias("type"), BN.field("value", "$.speaker", "string").alias("speaker"))
    return items, topics_pos, moments


def transcript_turns(bundles: BN.Bundles, ids: DataFrame) -> DataFrame:
    """ENR13: one row per transcript turn; id from the position, turn_index
    from the record's ``index``; absent sentence '' and speaker 'Unknown'."""
    return (BN.exploded(bundles, "transcript.json", "data").join(ids, "folder")
            .select(F.concat("meeting_id", F.lit("_t_"), F.col("pos").cast("string")).alias("id"), "meeting_id", "pos",
                    BN.field("value", "$.sentence", "string", F.lit("")).alias("sentence"),
                    BN.field("value", "$.speaker_name", "string", F.lit("Unknown")).alias("speaker_name"),
                    BN.field("value", "$.sentimentType", "string").alias("sentiment_type"),
                    BN.field("value", "$.time", "double").alias("time"),
                    BN.field("value", "$.endTime", "double").alias("end_time"),
                    BN.field("value", "$.averageConfidence", "double").alias("average_confidence"),
                    BN.field("value", "$.index", "int").alias("turn_index")))


def speaker_meta(bundles: BN.Bundles, ids: DataFrame) -> DataFrame:
    sm = _doc_of(bundles, "speaker-meta.json").join(ids, "folder")
    return sm.select("meeting_id", F.explode(BN.speaker_meta_values("doc")).alias("speaker"))


def _materialise(df: DataFrame, work_dir: str | None, name: str) -> DataFrame:
    """Write a frame read by several consumers once as Parquet (cutting its
    lineage) and read it back; without a work folder keep it lazy."""
    if not work_dir:
        return df
    path = os.path.join(work_dir, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def build_tables(spark: SparkSession, bundles: BN.Bundles, d: Dictionaries = DEFAULT,
                 work_dir: str | None = None) -> dict[str, DataFrame]:
    """All eight tables from the accepted, staged bundle files. With
    ``work_dir`` the meeting rows and the transcript turns -- each read by
    several tables -- are parsed out of the documents once."""
    meetings = _materialise(meetings_table(bundles, d), work_dir, "meetings")
    ids = meetings.select("folder", "meeting_id")
    items, topics_pos, moments = summary_children(bundles, ids, d)
    turns = _materialise(transcript_turns(bundles, ids), work_dir, "turns")
    roles = E.speaker_roles(turns, meetings.select("meeting_id", "all_emails", "host", "call_type"), "speaker_name", d)
    mentions = E.turn_mentions(turns, "sentence", "speaker_name", d)
    ents = E.entities(mentions)
    nodes, edges = G.build_graph(
        spark, meetings.select("meeting_id", "title", "call_type", "account"),
        items.select("id", "meeting_id", "task", "owner", "pos"),
        topics_pos.select("meeting_id", "topic", "pos"),
        turns.select("meeting_id", "speaker_name", "pos"),
        mentions, ents, speaker_meta(bundles, ids), d)
    return {
        "meetings": SK.align(meetings, S.MEETINGS),
        "transcript_segments": SK.align(roles, S.TRANSCRIPT_SEGMENTS),
        "action_items": SK.align(items, S.ACTION_ITEMS),
        "topics": SK.align(topics_pos, S.TOPICS),
        "key_moments": SK.align(moments, S.KEY_MOMENTS),
        "entities": SK.align(ents, S.ENTITIES),
        "graph_nodes": SK.align(nodes, S.GRAPH_NODES),
        "graph_edges": SK.align(edges, S.GRAPH_EDGES),
    }


def ingest(spark: SparkSession, bundle_root: str, out_dir: str, d: Dictionaries = DEFAULT,
           write: bool = True, check_keys: bool = True) -> Ingested:
    """Run the whole ingestion; tables are written under ``out_dir`` (full
    refresh) and returned as DataFrames reading the written Parquet."""
    staged = BN.stage_bundles(spark, bundle_root, os.path.join(out_dir, "_staging"))
    status = BN.gate(staged.files, folders=staged.folders)
    tables = build_tables(spark, BN.accepted(staged, status), d, work_dir=os.path.join(out_dir, "_work"))
    if write:
        # computed once: the key check reads the drafts, the commit names them
        drafts = os.path.join(out_dir, "_work", "tables")
        tables = {n: _materialise(t, drafts, n) for n, t in tables.items()}
    if check_keys:
        for name, (_, keys) in S.TABLES.items():
            SK.enforce_keys(tables[name], keys, name)
    if write:
        ST.refresh(tables, out_dir, KEYED)
        status.write.mode("overwrite").parquet(os.path.join(out_dir, "_ingest_status"))
        tables = load_tables(spark, out_dir)
        status = spark.read.parquet(os.path.join(out_dir, "_ingest_status"))
    return Ingested(tables, status, BN.rejects(status), BN.report(status))


def load_tables(spark: SparkSession, out_dir: str) -> dict[str, DataFrame]:
    """SRC3: the stored tables, all of one state."""
    return ST.load(spark, out_dir)
