"""Operators against brute force on small inputs, plan checks, invariants."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from testpaths import SF_SMALL

from colloquy.operators import analytics as A
from colloquy.operators import graph as G
from colloquy.operators import selection, sinks
from colloquy.operators.ordering import group_ordinals, top_k_per_group
from colloquy.plans import detail as DT
from colloquy.plans.registry import all_queries
from colloquy.sources import bindings as B


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_group_ordinals_hot_group(spark):
    rnd = random.Random(7)
    rows = [(0 if rnd.random() < 0.5 else rnd.randint(1, 20), rnd.randint(0, 30), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, k int, id int").repartition(13)
    got = {r.id: (r.ordinal, r.n) for r in group_ordinals(df, "g", ["k", "id"], size_col="n").collect()}
    expect = {}
    for g in {r[0] for r in rows}:
        members = sorted((k, i) for gg, k, i in rows if gg == g)
        for pos, (_, i) in enumerate(members, 1):
            expect[i] = (pos, len(members))
    assert got == expect


def test_group_ordinals_null_group(spark):
    df = spark.createDataFrame([(None, 2, 1), (None, 1, 2), (1, 1, 3)], "g int, k int, id int")
    got = {r.id: (r.ordinal, r.n) for r in group_ordinals(df, "g", ["k", "id"], size_col="n").collect()}
    assert got == {2: (1, 2), 1: (2, 2), 3: (1, 1)}


def test_group_ordinals_descending(spark):
    df = spark.createDataFrame([(1, 5, 1), (1, 7, 2), (1, 6, 3), (2, 1, 4)], "g int, k int, id int")
    got = {r.id: r.ordinal for r in group_ordinals(df, "g", ["k", "id"], descending=True).collect()}
    assert got == {2: 1, 3: 2, 1: 3, 4: 1}


def test_top_k_per_group_uses_group_limit(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    top = top_k_per_group(df, "g", [F.col("v").desc()], 2)
    assert sorted((r.g, r.v) for r in top.collect()) == sorted([(0, 999), (0, 996), (1, 997), (1, 994), (2, 998), (2, 995)])
    assert "WindowGroupLimit" in plan_text(top)


def test_quartiles_match_numpy(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), float(rnd.randint(0, 50)) / 7) for _ in range(501)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: (r.q25, r.q50, r.q75) for r in A.exact_quartiles(df, "g", "x").collect()}
    for g in "ab":
        xs = np.array([x for gg, x in rows if gg == g])
        exp = np.quantile(xs, [0.25, 0.5, 0.75])
        assert np.allclose(got[g], exp, rtol=0, atol=1e-12)


def quartiles_of(rows, **settings):
    return {r[0]: tuple(r)[1:] for r in A.exact_quartiles(rows, "g", "x", **settings).collect()}


def test_quartiles_by_rounds_match_numpy(spark, monkeypatch):
    monkeypatch.setattr(selection, "PIECES", 8)  # more rounds
    rnd = random.Random(8)
    rows = [("hot", rnd.lognormvariate(0, 6)) for _ in range(3000)]  # a group with most of the rows, far outliers
    rows += [("tied", rnd.choice([1.0, 1.0, 1.0, 1.0, 2.5, -3.0])) for _ in range(700)]
    rows += [("same", 4.0)] * 400 + [(None, float(k)) for k in range(333)] + [("one", -7.0), ("two", 1.0), ("two", 2.0), ("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    want = {g: np.quantile([x for k, x in rows if k == g and x is not None], [0.25, 0.5, 0.75])
            for g in ("hot", "tied", "same", None, "one", "two")}
    for finish in (0, 1, 5, 100, 10_000):
        got = quartiles_of(df, finish_rows=finish)
        assert set(got) == set(want) and all(np.allclose(got[g], want[g], rtol=1e-12, atol=0) for g in want)
    assert quartiles_of(df.limit(0)) == {}


def test_quartiles_of_whole_numbers_and_no_sort(spark):
    df = spark.range(5001).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 5003).alias("x"))
    got = quartiles_of(df, finish_rows=50)
    for g in (0, 1):
        assert np.allclose(got[g], np.quantile([i * 7919 % 5003 for i in range(5001) if i % 2 == g], [0.25, 0.5, 0.75]))
    assert "rangepartitioning" not in plan_text(A.exact_quartiles(df, "g", "x", finish_rows=50)).lower()


def test_dashboard_parts_equal_their_own_queries(spark):
    m, d = B.b3_meetings(spark, SF_SMALL), B.b3_dictionaries().with_(issue_patterns=B.B5_ISSUE_PATTERNS, feature_patterns=B.B5_FEATURE_PATTERNS)
    m = m.unionByName(m.limit(1).withColumns({c: F.lit(None).cast(m.schema[c].dataType) for c in ("title", "call_type", "overall_sentiment", "start_time")}))
    topics = B.b5_topics(spark, SF_SMALL)
    got = {}
    for r in DT.dashboard(m, topics, d).collect():
        got.setdefault(r.section, set()).add((r["item"], r["value"], r["n"], r["label"], r["support_calls"]))
    k = A.kpis(m).first()
    assert {x[:2] for x in got["kpis"]} == {("total_meetings", float(k.total_meetings)), ("average_sentiment", k.avg_sentiment), ("total_hours", k.total_hours)}
    for section, key in (("call_type", "call_type"), ("sentiment", "overall_sentiment")):
        assert {(x[0], x[2]) for x in got[section]} == {(r[key], r["count"]) for r in A.count_by(m, key).collect()}
    assert got["customer_risk"] == {(r.customer, r.avg_sentiment, r.total_calls, r.risk, r.support_calls)
                                    for r in A.account_risk_top(A.account_stats(m, d)).collect()}
    for section, patterns in (("product_risk", d.issue_patterns), ("feature_requests", d.feature_patterns)):
        assert {(x[0], x[2]) for x in got[section]} == {tuple(r) for r in A.topics_matching(topics, patterns).collect()}
    assert {x[:3] for x in got["timeline"]} == {tuple(r) for r in A.daily_timeline(m).collect()}
    none = DT.dashboard(m.limit(0), topics.limit(0), d).collect()
    assert {(r["item"], r["value"]) for r in none} == {("total_meetings", 0.0), ("average_sentiment", None), ("total_hours", None)}


def test_topics_of_all_sections_in_one_pass(spark):
    t = spark.createDataFrame([("bug and wish",), ("bug and wish",), ("bug",), ("other",), (None,)], "topic string")
    both = A.topics_by_section(t, {"a": ["bug"], "b": ["wish"], "c": []}, 1)
    assert sorted(map(tuple, both.collect())) == [("a", "bug and wish", 2), ("b", "bug and wish", 2)]
    ran = plan_text(both).split("Initial Plan")[0]
    assert ran.count("Scan ExistingRDD") == 1 and "WindowGroupLimit" in ran


def test_resolution_shift_brute_force(spark):
    rows = []
    rnd = random.Random(11)
    for m in range(12):
        for t in range(rnd.randint(0, 9)):
            rows.append((f"m{m}_t_{t}", m, rnd.choice([t, t]), rnd.choice(["negative", "positive", "neutral"])))
    seg = spark.createDataFrame(rows, "id string, meeting_id int, turn_index int, sentiment_type string")
    meetings = spark.createDataFrame([(m, f"T{m}", "External", 3.0) for m in range(12)],
                                     "meeting_id int, title string, call_type string, sentiment_score double")
    got = {r.meeting_id: r.resolution_shift for r in A.resolution_shift(seg, meetings).collect()}
    expect = {}
    for m in range(12):
        turns = sorted([(t, i, s) for i, mm, t, s in rows if mm == m])
        n = len(turns)
        first = [s for (_, _, s) in turns[: int(n // 3)] if True]
        last = [s for (_, _, s) in turns[n - int(n // 3):]] if n // 3 else []
        if first and last:
            expect[m] = last.count("positive") / len(last) - first.count("negative") / len(first)
    assert got == expect


def test_no_cartesian_or_python_udf_in_registered_plans(spark):
    from colloquy.plans.registry import all_queries
    for name, query in all_queries().items():
        text = plan_text(query.build(spark, SF_SMALL))
        assert "CartesianProduct" not in text, name
        assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text, name


def test_resolution_plan_has_no_window_on_meeting(spark):
    seg = B.b1_segments(spark, SF_SMALL)
    df = A.resolution_shift(seg, B.b3_meetings(spark, SF_SMALL))
    text = plan_text(df)
    # the only windows are over the small per-chunk table, partitioned by key
    assert "rangepartitioning" in text.lower()


def test_degree_invariant(spark):
    nodes, edges = B.b7_nodes(spark, SF_SMALL), B.b7_edges(spark, SF_SMALL)
    total = G.degree_centrality(nodes, edges).agg(F.sum("degree")).first()[0]
    ids = nodes.select("id")
    ends = G.edge_ends(edges)
    attached = ends.join(ids, ends.node_id == ids.id, "left_semi").count()
    assert total == attached
    assert attached <= 2 * edges.count()


def test_pivot_total_and_shares(spark):
    t = B.b5_topics(spark, SF_SMALL)
    m = B.b3_meetings(spark, SF_SMALL)
    p = A.topic_pivot(A.topic_call_type_counts(t, m))
    for r in p.collect():
        assert r.Total == r.Support + r.Internal + r.External
    ct = A.crosstab(B.b1_segments(spark, SF_SMALL), "speaker_role", "sentiment_type", ("negative", "neutral", "positive"))
    for r in A.crosstab_share(ct, "speaker_role", ("negative", "neutral", "positive")).collect():
        assert abs(r.negative + r.neutral + r.positive - 100.0) < 1e-9


def test_tier_distribution_lists_empty_tiers(spark):
    df = spark.createDataFrame([(10.0,), (0.0,), (None,)], "composite_risk_score double")
    got = [(r.risk_tier, r["count"]) for r in A.tier_distribution(A.with_risk_tier(df)).collect()]
    assert got == [("Low", 1), ("Medium", 0), ("High", 0)]


def test_approx_quartiles_close_to_exact(spark):
    rnd = random.Random(5)
    df = spark.createDataFrame([(rnd.choice("xy"), rnd.random()) for _ in range(4000)], "g string, v double")
    exact = {r.g: r for r in A.exact_quartiles(df, "g", "v").collect()}
    for r in A.approx_quartiles(df, "g", "v").collect():
        for q in ("q25", "q50", "q75"):
            assert abs(r[q] - exact[r.g][q]) < 0.01


def test_scale_conf():
    from colloquy.session import scale_conf
    c = scale_conf(100 << 40, 8000)
    assert int(c["spark.sql.shuffle.partitions"]) == (100 << 40) // (256 << 20)
    assert int(scale_conf(1 << 20, 8)["spark.sql.shuffle.partitions"]) == 24


def test_dictionary_join_in_slices(spark, monkeypatch):
    from colloquy.operators import containment as K, enrich as E
    m = spark.createDataFrame([(1, "Helix Data sync"), (2, "nothing")], "meeting_id int, title string")
    dic = spark.createDataFrame([("helix data", 0), ("sync", 1)], "term string, rank int")
    got = {r.meeting_id: r.match for r in E.dictionary_first_match(m, "title", dic, ["meeting_id"]).collect()}
    assert got == {1: "helix data", 2: None}
    monkeypatch.setattr(K, "FEW_TERMS", 0)
    monkeypatch.setattr(K, "SLICE_TERMS", 1)
    again = {r.meeting_id: r.match for r in E.dictionary_first_match(m, "title", dic, ["meeting_id"]).collect()}
    assert again == got


def test_search_takes_backslashes_and_batches_of_any_size(spark, monkeypatch):
    from colloquy.operators import containment as K, filters as FL, graph as G, retrieval as R
    titles = [(1, "C:\\temp files"), (2, "0\\% done"), (3, "plain 50% off"), (4, "tail \\")]
    m = spark.createDataFrame([(i, t, "", "ok", 3.0, "External") for i, t in titles],
                              "meeting_id long, title string, summary string, overall_sentiment string, sentiment_score double, call_type string")
    lines = spark.createDataFrame([], "meeting_id long, turn_index int, sentence string, time double, speaker_name string, sentiment_type string")
    want = {"C:\\temp": {1}, "0\\%": {2}, "\\": {1, 2, 4}, "50%": {3}, "PLAIN": {3}, "d_ne": {2}}
    for needle, ids in want.items():
        assert {r.meeting_id for r in m.filter(FL.meeting_filters(search=needle)).collect()} == ids
    q = R.question_batch(spark, list(enumerate(want)))
    for size in (100, 2):
        monkeypatch.setattr(K, "FEW_TERMS", 0 if size < 10 else K.FEW_TERMS)
        monkeypatch.setattr(K, "SLICE_TERMS", size)
        got = {}
        for r in R.search(m, lines, q)[0].collect():
            got.setdefault(r.qid, set()).add(r.meeting_id)
        assert got == dict(enumerate(want.values()))
    nodes = m.select(F.col("meeting_id").cast("string").alias("id"), F.col("title").alias("label"), F.lit("Meeting").alias("type"))
    edges = spark.createDataFrame([], "source string, target string, relation string")
    assert {r.id for r in G.neighbourhood(nodes, edges, "C:\\temp")[0].collect()} == {"1"}


def test_strip_ws_takes_unicode_blanks(spark):
    from colloquy.functions import text as X
    df = spark.createDataFrame([("\u00a0 a b\u2003",)], "t string")
    assert df.select(X.strip_ws("t").alias("t")).first().t == "a b"


def test_key_moments_by_time(spark):
    from colloquy.plans import detail as D
    m = spark.createDataFrame([("m", "t", "External", "ok", 3.0)], "meeting_id string, title string, call_type string, overall_sentiment string, sentiment_score double")
    km = spark.createDataFrame([("m_km_0", "m", 12.0, "late", "praise", "s"), ("m_km_1", "m", 3.5, "early", "praise", "s")],
                               "id string, meeting_id string, time double, text string, type string, speaker string")
    got = D.meeting_detail(m, key_moments=km).collect()
    assert [r.text for r in got if r.section == "key_moments"] == ["early", "late"]


def test_touching_edges_read_each_edge_once(spark):
    rnd = random.Random(11)
    ids = [f"n{i}" for i in range(60)]
    hub = [("n0", f"x{i}", "R") for i in range(500)]  # a hub with dangling ends
    edges = list({(rnd.choice(ids), rnd.choice(ids + ["gone"]), rnd.choice("RS")) for _ in range(300)} | set(hub) | {("n1", "n1", "R")})
    nodes = [(i, f"Label {i}" if k % 3 else f"Seed {i}", "T") for k, i in enumerate(ids)]
    n = spark.createDataFrame(nodes, "id string, label string, type string")
    e = spark.createDataFrame(edges, "source string, target string, relation string")
    around, touching = G.neighbourhood(n, e, "seed")
    seeds = {i for i, label, _ in nodes if label.startswith("Seed")}
    expected = [x for x in edges if x[0] in seeds or x[1] in seeds]
    assert sorted(tuple(r) for r in touching.collect()) == sorted(expected)
    ends = seeds | {v for x in expected for v in x[:2]}
    assert sorted(r.id for r in around.collect()) == sorted(ends & set(ids))
    plan = plan_text(touching)
    assert "Generate" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("name", ["fil6_non_internal", "fil10_point_lookup", "fil11_date_drilldown"])
def test_listed_meetings_are_whole(spark, scratch, name):
    """The list queries return the summary of each meeting as well."""
    import datetime as dt

    events = [(1, dt.datetime(2024, 1, 1, 9), 42, "view", "{}", 1.0), (2, dt.datetime(2024, 1, 1, 10), 44, "error", "{}", 2.0)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, props string, value double").write.parquet(f"{scratch}/events.parquet")
    said = [(42, 0, "user", "first"), (42, 1, "assistant", "second"), (44, 0, "user", "alone")]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(f"{scratch}/conversations.parquet")
    got = {r.meeting_id: (r.title, r.summary) for r in all_queries()[name].build(spark, scratch).collect()}
    expected = {42: ("first", "second"), 44: ("alone", None)}
    assert got == ({42: expected[42]} if name == "fil10_point_lookup" else expected)


def test_key_violations_dealt_by_key(spark):
    """The tasks are as asked for, whatever AQE would join up; the rows are the same."""
    rows = [(i % 700, str(i % 700)) for i in range(1000)] + [(None, "a"), (5000, None)]
    df = spark.createDataFrame(rows, "a long, b string")
    dealt = sinks.key_violations(df, ["a", "b"], tasks=13)
    assert dealt.rdd.getNumPartitions() == 13
    assert "hashpartitioning(a" in plan_text(dealt) and ", 13), REPARTITION_BY_NUM" in plan_text(dealt)
    got = sorted(map(tuple, dealt.select(F.coalesce("a", F.lit(-1)), F.coalesce("b", F.lit("-")), "rows").collect()))
    assert got == sorted([(i, str(i), 2) for i in range(300)] + [(-1, "a", 1), (5000, "-", 1)], key=lambda r: (r[0], r[1]))
    assert dealt.count() == sinks.key_violations(df, ["a", "b"]).count()
