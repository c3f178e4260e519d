"""Property graph: construction rules (GRB1-GRB9) and graph queries
(ALG9, ALG11-ALG13).

Node ids share one namespace across types; when several rules write the same
id the last writer wins, where "last" is the total order
(meeting_id, rule, position) -- a ``max_by`` aggregate, partially combined
before the shuffle. Edge sets are de-duplicated the same way. Queries use
semi-joins instead of IN-lists, and degree counts aggregate edge ends before
joining labels, so a hub node costs one partial-aggregate row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dictionaries as DICT
from ..dictionaries import DEFAULT, Dictionaries
from ..functions import classify as C
from ..functions import text as X
from .filters import like_pattern
from .ordering import global_top_k

# Rule numbers give the write order inside one meeting.
RULE_SEED, RULE_MEETING, RULE_CUSTOMER, RULE_ACTION, RULE_OWNER, RULE_TOPIC, RULE_SPEAKER = range(7)


def _node(df: DataFrame, id_col, label_col, kind: str, meeting_col, rule: int, pos_col=None) -> DataFrame:
    return df.select(F.col(id_col).cast("string").alias("id") if isinstance(id_col, str) else id_col.alias("id"),
                     (F.col(label_col) if isinstance(label_col, str) else label_col).cast("string").alias("label"),
                     F.lit(kind).alias("type"),
                     (F.col(meeting_col).cast("string") if isinstance(meeting_col, str) else meeting_col).alias("_m"),
                     F.lit(rule).alias("_rule"),
                     (F.col(pos_col).cast("long") if pos_col else F.lit(0).cast("long")).alias("_pos"))


def _edge(df: DataFrame, src, dst, relation: str) -> DataFrame:
    def c(x):
        return (F.col(x) if isinstance(x, str) else x).cast("string")
    return df.select(c(src).alias("source"), c(dst).alias("target"), F.lit(relation).alias("relation"))


def seed_nodes(spark, d: Dictionaries = DEFAULT) -> DataFrame:
    """GRB1: every product and competitor, mentioned or not."""
    rows = [(p, p, "Product", i) for i, p in enumerate(d.products)]
    rows += [(c, c, "Competitor", len(d.products) + i) for i, c in enumerate(d.competitors)]
    df = spark.createDataFrame(rows, "id string, label string, type string, pos long")
    return df.select("id", "label", "type", F.lit("").alias("_m"), F.lit(RULE_SEED).alias("_rule"), F.col("pos").alias("_pos"))


def build_graph(spark, meetings: DataFrame, action_items: DataFrame, topics: DataFrame,
                speakers: DataFrame, mentions: DataFrame, entities: DataFrame, speaker_meta: DataFrame,
                d: Dictionaries = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """GRB1-GRB9: nodes and edges of the knowledge graph.

    meetings      meeting_id, title, call_type, account
    action_items  id, meeting_id, task, owner, pos
    topics        meeting_id, topic, pos
    speakers      meeting_id, speaker_name, pos   (one row per turn)
    mentions      meeting_id, speaker_name, entity_name, entity_type
    entities      meeting_id, entity_name, entity_type
    speaker_meta  meeting_id, speaker           (speaker-meta values)
    """
    customer_ok = (F.col("call_type") != "Internal") & (F.col("account") != DICT.UNKNOWN_CUSTOMER)
    customers = meetings.filter(customer_ok)
    owners = action_items.filter(F.col("owner") != DICT.UNASSIGNED)
    nodes = (seed_nodes(spark, d)
             .unionByName(_node(meetings, "meeting_id", "title", "Meeting", "meeting_id", RULE_MEETING))
             .unionByName(_node(customers, "account", "account", "Customer", "meeting_id", RULE_CUSTOMER))
             .unionByName(_node(action_items, "id", X.label_with_ellipsis("task", DICT.ACTION_LABEL_CHARS),
                                "ActionItem", "meeting_id", RULE_ACTION, "pos"))
             .unionByName(_node(owners, "owner", "owner", "Speaker", "meeting_id", RULE_OWNER, "pos"))
             .unionByName(_node(topics, "topic", "topic", "Topic", "meeting_id", RULE_TOPIC, "pos"))
             .unionByName(_node(speakers, "speaker_name", "speaker_name", "Speaker", "meeting_id", RULE_SPEAKER, "pos")))
    # SNK5: last writer wins per id; ActionItem and owner rules interleave
    # per item in the reference, so order by (meeting, position, rule) there.
    interleaved = F.col("_rule").isin(RULE_ACTION, RULE_OWNER)
    seq = F.struct(F.col("_m"), F.when(interleaved, F.lit(RULE_ACTION)).otherwise(F.col("_rule")).alias("r"),
                   F.col("_pos"), F.col("_rule"))
    final_nodes = (nodes.groupBy("id")
                   .agg(F.max_by(F.struct("label", "type"), seq).alias("_v"))
                   .select("id", "_v.label", "_v.type"))

    edges = (_edge(customers, "meeting_id", "account", "AFFECTS")
             .unionByName(_edge(action_items, "meeting_id", "id", "HAS_ACTION_ITEM"))
             .unionByName(_edge(owners, "owner", "id", "OWNS"))
             .unionByName(_edge(topics, "meeting_id", "topic", "DISCUSSES_TOPIC"))
             .unionByName(_edge(speakers, "meeting_id", "speaker_name", "HAS_SPEAKER"))
             .unionByName(_edge(mentions.filter(F.col("entity_type") == "Competitor"), "speaker_name", "entity_name", "MENTIONS"))
             .unionByName(_edge(mentions.filter(F.col("entity_type") == "Product"), "speaker_name", "entity_name", "DISCUSSES"))
             .unionByName(_edge(entities.filter(F.col("entity_type") == "Competitor"), "meeting_id", "entity_name", "MENTIONS_COMPETITOR"))
             .unionByName(_edge(entities.filter(F.col("entity_type") == "Product"), "meeting_id", "entity_name", "DISCUSSES_PRODUCT"))
             .unionByName(speaker_topic_edges(speaker_meta, topics)))
    return final_nodes, edges.distinct()


def speaker_topic_edges(speaker_meta: DataFrame, topics: DataFrame) -> DataFrame:
    """GRB8 (JOI10): every speaker-meta name of a meeting x every topic of that
    meeting. Both sides are de-duplicated per meeting before the equi-join,
    and the pairs are de-duplicated globally after it."""
    sp = speaker_meta.select("meeting_id", F.col("speaker").cast("string").alias("source")).distinct()
    tp = topics.select("meeting_id", F.col("topic").cast("string").alias("target")).distinct()
    return (sp.join(tp, "meeting_id").select("source", "target", F.lit("DISCUSSES_TOPIC").alias("relation"))
            .distinct())


# ------------------------------------------------------------------ queries
def edge_ends(edges: DataFrame) -> DataFrame:
    """SET1: UNION ALL of sources and targets, read in one scan."""
    return edges.select(F.explode(F.array("source", "target")).alias("node_id"))


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """ALG9 (JOI7): degree per (label, type). Self-loops count twice, nodes
    without edges and dangling ends are absent, equal labels merge."""
    deg = edge_ends(edges).groupBy("node_id").agg(F.count(F.lit(1)).alias("_d"))
    return (nodes.join(deg, nodes.id == deg.node_id)
            .groupBy("label", "type").agg(F.sum("_d").cast("long").alias("degree"))
            .orderBy(F.col("degree").desc(), F.col("label"), F.col("type")))


# slots of the seed filter sent to the executors: at most so many integers
SEED_SLOTS = 1 << 20


def _slot(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(SEED_SLOTS)).cast("int")


def touching_edges(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """JOI8: the edges with an end among ``seeds(_sid)``, distinct ids.

    Each edge is read once and stays one row. Where it is scanned, the slots
    of its ends are looked up in the broadcast slots of the seeds, a filter of
    bounded size; only what may touch a seed is joined with the ids."""
    taken = F.broadcast(seeds.select(_slot("_sid").alias("_taken")).distinct())
    near = (edges.join(taken.withColumnRenamed("_taken", "_s"), _slot("source") == F.col("_s"), "left")
            .join(taken.withColumnRenamed("_taken", "_t"), _slot("target") == F.col("_t"), "left")
            .filter("_s IS NOT NULL OR _t IS NOT NULL").drop("_s", "_t"))
    return (near.join(seeds.withColumnRenamed("_sid", "_from"), near.source == F.col("_from"), "left")
            .join(seeds.withColumnRenamed("_sid", "_to"), near.target == F.col("_to"), "left")
            .filter("_from IS NOT NULL OR _to IS NOT NULL").select(*edges.columns))


def neighbourhood(nodes: DataFrame, edges: DataFrame, query: str) -> tuple[DataFrame, DataFrame]:
    """ALG11 (JOI8, FIL9, SET2): seeds are nodes whose label contains the
    query (case-insensitive, wildcards kept); edges touching a seed; nodes =
    seeds plus the existing ends of those edges. Node ids are unique."""
    sought = F.col("label").ilike(like_pattern(query))
    seeds = nodes.filter(sought).select(F.col("id").alias("_sid"))
    touching = touching_edges(edges, seeds)
    ends = touching.select(F.explode(F.array("source", "target")).alias("_end")).distinct()
    around = nodes.join(ends, nodes.id == ends._end, "left").filter(sought | F.col("_end").isNotNull())
    return around.select(*nodes.columns), touching


def density_subgraph(nodes: DataFrame, edges: DataFrame, limit: int = DICT.GRAPH_NODE_LIMIT) -> tuple[DataFrame, DataFrame]:
    """ALG12 (SRT3): the first ``limit`` nodes by type priority (id breaks
    ties) and the edges with both ends among them. The node set is bounded
    by ``limit``, so it is broadcast into two semi-joins."""
    top = global_top_k(nodes, [C.ordered_rank("type", DICT.NODE_TYPE_PRIORITY), F.col("id")], limit)
    ids = F.broadcast(top.select(F.col("id").alias("_id")))
    inner = (edges.join(ids, edges.source == ids._id, "left_semi")
             .join(ids, edges.target == ids._id, "left_semi"))
    return top, inner


def connections(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """ALG13 (JOI11): for each edge touching the node, the relation and the
    node at the other end (edges whose other end has no node are skipped)."""
    touching = edges.filter((F.col("source") == node_id) | (F.col("target") == node_id))
    other = touching.select("relation", F.when(F.col("source") == node_id, F.col("target"))
                            .otherwise(F.col("source")).alias("neighbour_id"))
    return (other.join(nodes, other.neighbour_id == nodes.id)
            .select("relation", "neighbour_id", F.col("label").alias("neighbour_label"),
                    F.col("type").alias("neighbour_type")))
