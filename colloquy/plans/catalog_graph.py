"""Graph queries: degree centrality, neighbourhood, density-limited subgraph
and connection inspector on binding B7; the knowledge graph built by the
ingestion rules (GRB1-GRB9) from the meeting bindings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as C
from ..operators import enrich as E
from ..operators import graph as G
from ..sources import bindings as B
from . import sqltext as Q
from .catalog_actions import ITEMS_SQL
from .catalog_meetings import ACCOUNT_RESOLVE_SQL
from .registry import register

SEARCH = "nation_1"
NODE = "n7"


def _g(spark, root):
    return B.b7_nodes(spark, root), B.b7_edges(spark, root)


def degree_sql(nodes: str, edges: str) -> str:
    """Edges out of and into each node counted apart, then added."""
    return f"""
SELECT label, type, CAST(sum(coalesce(outgoing, 0) + coalesce(incoming, 0)) AS BIGINT) AS degree
FROM {nodes}
LEFT JOIN (SELECT source, count(*) AS outgoing FROM {edges} GROUP BY source) ON source = id
LEFT JOIN (SELECT target, count(*) AS incoming FROM {edges} GROUP BY target) ON target = id
GROUP BY label, type HAVING degree > 0"""


@register("alg9_degree_centrality", B.with_bindings(degree_sql("b7_nodes", "b7_edges") + " ORDER BY degree DESC, label, type",
                                                    "b7_nodes", "b7_edges"))
def alg9_degree_centrality(spark, root):
    """ALG9 (JOI7, SET1): degree per (label, type)."""
    return G.degree_centrality(*_g(spark, root))


@register("set1_edge_ends", B.with_bindings(
    "SELECT unnest([source, target]) AS node_id FROM b7_edges", "b7_edges"))
def set1_edge_ends(spark, root):
    """SET1: all edge ends (sources and targets, with repeats)."""
    return G.edge_ends(B.b7_edges(spark, root))


NEIGH_CTES = {
    "seeds": f"SELECT id FROM b7_nodes WHERE label ILIKE '%{SEARCH}%'",
    "touching": "SELECT source, target, relation FROM b7_edges WHERE source IN (SELECT id FROM seeds) OR target IN (SELECT id FROM seeds)",
}


@register("alg11_neighbourhood_nodes", B.with_bindings("""
SELECT * FROM b7_nodes WHERE id IN (SELECT id FROM seeds UNION SELECT source FROM touching UNION SELECT target FROM touching)""",
                                                       "b7_nodes", "b7_edges", extra=NEIGH_CTES))
def alg11_neighbourhood_nodes(spark, root):
    """ALG11 (SET2, FIL9): seed nodes matching the search and their existing
    neighbours."""
    return G.neighbourhood(*_g(spark, root), SEARCH)[0]


@register("alg11_neighbourhood_edges", B.with_bindings("SELECT * FROM touching", "b7_nodes", "b7_edges", extra=NEIGH_CTES))
def alg11_neighbourhood_edges(spark, root):
    """ALG11 (JOI8): edges touching a seed node."""
    return G.neighbourhood(*_g(spark, root), SEARCH)[1]


TOP_SQL = {"top": """
SELECT * FROM b7_nodes ORDER BY CASE type WHEN 'Product' THEN 0 WHEN 'Competitor' THEN 1 WHEN 'Meeting' THEN 2
                                          WHEN 'Customer' THEN 3 ELSE 4 END, id LIMIT 120"""}


@register("alg12_subgraph_nodes", B.with_bindings("SELECT * FROM top", "b7_nodes", extra=TOP_SQL))
def alg12_subgraph_nodes(spark, root):
    """ALG12 (SRT3): the 120 display nodes by type priority."""
    return G.density_subgraph(*_g(spark, root))[0]


@register("alg12_subgraph_edges", B.with_bindings("""
SELECT * FROM b7_edges WHERE source IN (SELECT id FROM top) AND target IN (SELECT id FROM top)""",
                                                  "b7_nodes", "b7_edges", extra=TOP_SQL))
def alg12_subgraph_edges(spark, root):
    """ALG12 (FIL9): edges with both ends among the display nodes."""
    return G.density_subgraph(*_g(spark, root))[1]


@register("alg13_connections", B.with_bindings(f"""
SELECT e.relation, e.neighbour_id, n.label AS neighbour_label, n.type AS neighbour_type
FROM (SELECT relation, CASE WHEN source = '{NODE}' THEN target ELSE source END AS neighbour_id
      FROM b7_edges WHERE source = '{NODE}' OR target = '{NODE}') e
JOIN b7_nodes n ON n.id = e.neighbour_id""", "b7_nodes", "b7_edges"))
def alg13_connections(spark, root):
    """ALG13 (JOI11): relation and neighbour of every edge of one node."""
    return G.connections(*_g(spark, root), NODE)


# ------------------------------------------------ knowledge graph (GRB1-9)
def _kg(spark, root):
    d3 = B.b3_dictionaries().with_(ignored_domains=B.B9_IGNORED_DOMAINS)
    mails = B.b9_addresses(spark, root).select("meeting_id", F.array("email").alias("all_emails"))
    meetings = (B.b3_meetings(spark, root).join(mails, "meeting_id", "left")
                .select("meeting_id", "title", "call_type",
                        C.resolve_account("title", F.coalesce("all_emails", F.array().cast("array<string>")), d3).alias("account")))
    items = E.action_items(B.b8_items(spark, root), "meeting_id", "pos", "item", keep_pos=True)
    topics = B.b5_topics(spark, root).withColumn("pos", F.lit(0))
    text = B.b2_text(spark, root)
    speakers = text.select("meeting_id", "speaker_name", F.col("turn_index").alias("pos"))
    mentions = B.b4_mentions(spark, root)
    ents = E.entities(mentions)
    meta = text.select("meeting_id", F.col("speaker_name").alias("speaker")).distinct()
    return G.build_graph(spark, meetings, items, topics, speakers, mentions, ents, meta, B.B2_DICTIONARIES)


def _seed_sql() -> str:
    d = B.B2_DICTIONARIES
    rows = [(p, "Product", i) for i, p in enumerate(d.products)]
    rows += [(c, "Competitor", len(d.products) + i) for i, c in enumerate(d.competitors)]
    return " UNION ALL ".join(f"SELECT {Q.lit(n)} AS id, {Q.lit(n)} AS label, {Q.lit(t)} AS type, '' AS m, 0 AS r, "
                              f"CAST({i} AS BIGINT) AS pos, 0 AS rule" for n, t, i in rows)


KG_CTES = {
    "acct": ACCOUNT_RESOLVE_SQL.replace("FROM m LEFT JOIN", "FROM b3_meetings m LEFT JOIN"),
    "km": "SELECT m.meeting_id, m.title, m.call_type, a.account FROM b3_meetings m JOIN acct a ON a.meeting_id = m.meeting_id",
    "items": ITEMS_SQL,
    "items_pos": "SELECT i.*, b.pos FROM items i JOIN b8_items b ON i.id = concat(b.meeting_id, '_ai_', b.pos)",
    "cand": f"""
{_seed_sql()}
UNION ALL SELECT CAST(meeting_id AS VARCHAR), title, 'Meeting', CAST(meeting_id AS VARCHAR), 1, CAST(0 AS BIGINT), 1 FROM km
UNION ALL SELECT account, account, 'Customer', CAST(meeting_id AS VARCHAR), 2, CAST(0 AS BIGINT), 2 FROM km
          WHERE call_type != 'Internal' AND account != 'Unknown Customer'
UNION ALL SELECT id, concat(substr(task, 1, 40), '...'), 'ActionItem', CAST(meeting_id AS VARCHAR), 3, CAST(pos AS BIGINT), 3 FROM items_pos
UNION ALL SELECT owner, owner, 'Speaker', CAST(meeting_id AS VARCHAR), 3, CAST(pos AS BIGINT), 4 FROM items_pos WHERE owner != 'Unassigned'
UNION ALL SELECT topic, topic, 'Topic', CAST(meeting_id AS VARCHAR), 5, CAST(0 AS BIGINT), 5 FROM b5_topics
UNION ALL SELECT speaker_name, speaker_name, 'Speaker', CAST(meeting_id AS VARCHAR), 6, CAST(turn_index AS BIGINT), 6 FROM b2_text""",
}


@register("grb9_graph_nodes", B.with_bindings("""
SELECT id, label, type FROM (
  SELECT id, label, type, row_number() OVER (PARTITION BY id ORDER BY m DESC, r DESC, pos DESC, rule DESC) AS k FROM cand)
WHERE k = 1""", "b2_text", "b3_meetings", "b5_topics", "b8_items", "b9_addresses", extra=KG_CTES))
def grb9_graph_nodes(spark, root):
    """GRB1-GRB5, GRB9 (SNK5): knowledge-graph nodes, last writer wins."""
    return _kg(spark, root)[0]


KG_EDGES_SQL = """
SELECT DISTINCT * FROM (
  SELECT CAST(meeting_id AS VARCHAR) AS source, account AS target, 'AFFECTS' AS relation FROM km
    WHERE call_type != 'Internal' AND account != 'Unknown Customer'
  UNION ALL SELECT CAST(meeting_id AS VARCHAR), id, 'HAS_ACTION_ITEM' FROM items
  UNION ALL SELECT owner, id, 'OWNS' FROM items WHERE owner != 'Unassigned'
  UNION ALL SELECT CAST(meeting_id AS VARCHAR), topic, 'DISCUSSES_TOPIC' FROM b5_topics
  UNION ALL SELECT CAST(meeting_id AS VARCHAR), speaker_name, 'HAS_SPEAKER' FROM b2_text
  UNION ALL SELECT speaker_name, entity_name, 'MENTIONS' FROM b4_mentions WHERE entity_type = 'Competitor'
  UNION ALL SELECT speaker_name, entity_name, 'DISCUSSES' FROM b4_mentions WHERE entity_type = 'Product'
  UNION ALL SELECT CAST(meeting_id AS VARCHAR), entity_name, 'MENTIONS_COMPETITOR' FROM b4_entities WHERE entity_type = 'Competitor'
  UNION ALL SELECT CAST(meeting_id AS VARCHAR), entity_name, 'DISCUSSES_PRODUCT' FROM b4_entities WHERE entity_type = 'Product'
  UNION ALL SELECT s.speaker_name, t.topic, 'DISCUSSES_TOPIC' FROM (SELECT DISTINCT meeting_id, speaker_name FROM b2_text) s
            JOIN b5_topics t ON s.meeting_id = t.meeting_id)"""
KG_NAMES = ("b2_text", "b3_meetings", "b4_entities", "b5_topics", "b8_items", "b9_addresses")


@register("grb9_graph_edges", B.with_bindings(KG_EDGES_SQL, *KG_NAMES, extra=KG_CTES))
def grb9_graph_edges(spark, root):
    """GRB2-GRB8, GRB9 (SNK4): knowledge-graph edges, de-duplicated."""
    return _kg(spark, root)[1]


@register("grb8_speaker_topic_edges", B.with_bindings("""
SELECT DISTINCT s.speaker_name AS source, t.topic AS target, 'DISCUSSES_TOPIC' AS relation
FROM (SELECT DISTINCT meeting_id, speaker_name FROM b2_text) s JOIN b5_topics t ON s.meeting_id = t.meeting_id""",
    "b2_text", "b5_topics"))
def grb8_speaker_topic_edges(spark, root):
    """GRB8 (JOI10): speaker x topic edges within each meeting."""
    meta = B.b2_text(spark, root).select("meeting_id", F.col("speaker_name").alias("speaker"))
    return G.speaker_topic_edges(meta, B.b5_topics(spark, root))


@register("alg9_knowledge_graph_degree", B.with_bindings(degree_sql("nodes", "edges"), *KG_NAMES,
    extra={**KG_CTES,
           "nodes": "SELECT id, label, type FROM (SELECT id, label, type, row_number() OVER (PARTITION BY id ORDER BY m DESC, r DESC, pos DESC, rule DESC) AS k FROM cand) WHERE k = 1",
           "edges": KG_EDGES_SQL}))
def alg9_knowledge_graph_degree(spark, root):
    """ALG9 on the knowledge graph built from the meeting bindings."""
    nodes, edges = _kg(spark, root)
    return G.degree_centrality(nodes, edges)
