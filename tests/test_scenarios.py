"""The reference application's end-to-end checks, restated on the tables
ingested from the hand-made bundles (list, detail, dashboard, competitors,
search, answer routing, action-item update, graph views)."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import actions as ACT
from colloquy.operators import analytics as A
from colloquy.operators import filters as FL
from colloquy.operators import graph as G
from colloquy.operators import retrieval as R
from colloquy.plans import detail as DT


def test_tables_not_empty(ingested):
    res = ingested[0]
    for name in ("meetings", "transcript_segments", "action_items", "topics", "graph_nodes", "graph_edges"):
        assert res.tables[name].count() > 0, name


def test_search_finds_billing(spark, ingested):
    t = ingested[0].tables
    lines = t["transcript_segments"].select("meeting_id", "turn_index", "sentence", "time", "speaker_name", "sentiment_type")
    _, ranked, segs = R.search(t["meetings"], lines, R.question_batch(spark, [(1, "billing")]))
    hits = ranked.collect()
    quoted = {r.meeting_id for r in segs.collect()}
    assert hits and all("billing" in f"{r.title} {r.summary}".lower() or r.meeting_id in quoted for r in hits)
    assert len(hits) <= 10 and segs.count() <= 20


def test_answer_route_and_sources(spark, ingested):
    t = ingested[0].tables
    lines = t["transcript_segments"].select("meeting_id", "turn_index", "sentence", "time", "speaker_name", "sentiment_type")
    q = R.question_batch(spark, [(1, "Any billing problems?"), (2, "who is unhappy"), (3, "Okta"), (4, "Helix")])
    _, ranked, segs = R.search(t["meetings"], lines, q)
    routes = {r.qid: r.route for r in R.routes(q, ranked).collect()}
    assert routes == {1: "billing", 2: "churn", 3: "competitors", 4: "search"}
    assert R.sources(ranked).groupBy("qid").count().agg(F.max("count")).first()[0] <= 3
    ctx = {r.qid: r.context for r in R.context(q, ranked, segs).collect()}
    assert ctx[4].startswith("--- RELEVANT MEETINGS ---") and "--- RELEVANT TRANSCRIPT QUOTES ---" in ctx[4]


def test_list_meetings_page_and_total(ingested):
    m = ingested[0].tables["meetings"]
    page = FL.list_meetings(m, limit=3, offset=0)
    rows = page.collect()
    assert len(rows) == 3
    assert [r.start_time for r in rows] == sorted([r.start_time for r in rows], reverse=True)
    assert FL.count_meetings(m).first().total == m.count()
    assert FL.list_meetings(m, search="summit").count() == m.filter(F.lower("title").contains("summit")).count()


def test_meeting_detail_sections(ingested):
    t = ingested[0].tables
    d = DT.meeting_detail(t["meetings"], t["transcript_segments"], t["action_items"], t["topics"], t["key_moments"],
                          t["entities"], meeting_id="M01")
    sections = {r.section for r in d.collect()}
    assert sections == {"meeting", "transcript", "action_items", "topics", "key_moments", "entities"}
    turns = [r.pos for r in d.filter(F.col("section") == "transcript").collect()]
    assert turns == sorted(turns)
    assert DT.meeting_detail(t["meetings"], meeting_id="nope").count() == 0


def test_dashboard_shape(ingested):
    t = ingested[0].tables
    dash = DT.dashboard(t["meetings"], t["topics"])
    sections = {r.section for r in dash.collect()}
    assert {"kpis", "call_type", "sentiment", "timeline"} <= sections
    kpi = {r.item: r.value for r in dash.filter(F.col("section") == "kpis").collect()}
    assert kpi["total_meetings"] == t["meetings"].count()
    assert dash.filter(F.col("section") == "customer_risk").count() <= 12


def test_competitors(ingested):
    t = ingested[0].tables
    counts = {r.entity_name: r["count"] for r in A.mention_counts(t["entities"], "Competitor").collect()}
    assert counts.get("Okta") == 2 and counts.get("Duo") == 1
    rows = A.competitor_meetings(t["entities"], t["meetings"]).filter(F.col("competitor") == "Okta").collect()
    assert len(rows) == 2 and rows[0].start_time >= rows[1].start_time


def test_action_item_update_then_read_back(spark, ingested):
    items = ingested[0].tables["action_items"]
    first = items.orderBy("id").first().id
    updates = spark.createDataFrame([(first, "Closed", 1), (first, "Invalid", 2), ("missing", "Open", 3)],
                                    "id string, status string, seq int")
    new, rejects = ACT.apply_status_updates(items, updates)
    assert new.filter(F.col("id") == first).first().status == "Closed"
    assert {r.reason for r in rejects.collect()} == {"invalid status", "not found"}
    assert FL.pending_count(new).first().pending == items.count() - 1


def test_graph_views(ingested):
    t = ingested[0].tables
    nodes, edges = t["graph_nodes"], t["graph_edges"]
    top, inner = G.density_subgraph(nodes, edges)
    assert top.count() <= 120
    ids = {r.id for r in top.collect()}
    assert all(r.source in ids and r.target in ids for r in inner.collect())
    near_nodes, near_edges = G.neighbourhood(nodes, edges, "okta")
    assert near_edges.count() > 0
    assert {r.id for r in near_nodes.collect()} >= {"Okta"}
    conn = G.connections(nodes, edges, "Okta").collect()
    # a topic spelt "Okta" shares the node id, so topic edges appear too
    assert {"MENTIONS", "MENTIONS_COMPETITOR", "DISCUSSES_TOPIC"} <= {r.relation for r in conn}
    assert nodes.filter(F.col("id") == "Okta").first().type == "Topic"


def test_api_entry_points_run(spark, ingested):
    from colloquy.plans import api
    from colloquy.plans.ingest import load_tables
    t = load_tables(spark, ingested[3])
    page, total = api.list_meetings(t, search="summit", limit=5)
    assert page.count() <= 5 and total.first().total >= page.count()
    assert api.meeting_detail(t, "M01").filter("section = 'transcript'").count() == 9
    outs = [api.dashboard(t), *api.competitors(t), api.action_items(t, "Open"), api.graph(t)[0], api.graph(t, "okta")[1],
            api.connections(t, "Okta"), api.resolution_shift(t), *api.churn_risk(t), *api.topic_breakdown(t),
            *api.score_statistics(t), *api.role_sentiment(t), *api.action_workload(t), api.degree_centrality(t),
            *api.entity_load(t), api.sample(t, "meetings")]
    for df in outs:
        assert df.count() >= 0
    ctx, routes, sources, ranked, segs = api.ask(spark, t, [(1, "billing issues"), (2, "okta")])
    assert {r.route for r in routes.collect()} == {"billing", "competitors"}
    assert ctx.count() == 2
    answers = api.routed_answers(t, ranked)
    assert set(answers) == {"billing", "churn", "competitors", "search"}
    assert answers["competitors"].filter("entity_name = 'Okta'").count() == 1
    upd = spark.createDataFrame([("M01_ai_0", "Blocked", 1)], "id string, status string, seq int")
    new, rejects = api.update_action_items(t, upd)
    assert new.filter("id = 'M01_ai_0'").first().status == "Blocked" and rejects.count() == 0
