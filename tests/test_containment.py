"""Containment of many terms against plain Python, and its plan."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import containment as K
from colloquy.operators import enrich as E
from colloquy.operators import retrieval as R
from colloquy.plans.registry import all_queries


def like(text, pattern):
    """ILIKE with '%' and '_' only, by the usual two-pointer walk."""
    text, pattern = text.lower(), pattern.lower()
    t = p = 0
    star, mark = -1, 0
    while t < len(text):
        if p < len(pattern) and pattern[p] == "%":
            star, mark, p = p, t, p + 1
        elif p < len(pattern) and pattern[p] in ("_", text[t]):
            t, p = t + 1, p + 1
        elif star >= 0:
            p, mark = star + 1, mark + 1
            t = mark
        else:
            return False
    return all(c == "%" for c in pattern[p:])


@pytest.fixture()
def texts():
    rng = random.Random(3)
    words = ["alpha", "Beta", "gam\\ma", "ÉTÉ", "naïve", "x", "yz", "100%", "a_b", "new line\n", "okta"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(80)]
    return rows + [(80, None), (81, ""), (82, "ab" * 5000)]


@pytest.mark.parametrize("n", [20, 300])
def test_search_hits_equal_like(spark, texts, n):
    rng = random.Random(n)
    pieces = ["alpha", "bet", "m\\m", "été", "ï", "%", "_", "x y", "okta", "0% a", "zz", "\n", "bababa", "no such text"]
    questions = [(q, "".join(rng.choice(pieces) for _ in range(rng.randint(1, 2)))) for q in range(n)]
    lines = spark.createDataFrame([(i, 0, t, 0.0, "s", "n") for i, t in texts],
                                  "meeting_id long, turn_index long, sentence string, time double, speaker_name string, sentiment_type string")
    asked = spark.createDataFrame(questions, "qid long, question string")
    hits = R._hits(lines.select("meeting_id", "sentence"), asked, "sentence")
    assert ("NestedLoop" in hits._jdf.queryExecution().executedPlan().toString()) == (n <= K.FEW_TERMS)
    expected = {(q, i) for q, text in questions for i, t in texts if like(t or "", f"%{text}%") and t is not None or text.strip("%") == "" and t is not None}
    got = [(r.qid, r.meeting_id) for r in hits.collect()]
    assert len(got) == len(set(got))
    assert {g for g in got if g[1] != 80} == expected


@pytest.mark.parametrize("slices", [200_000, 37])
def test_dictionary_of_any_size(spark, texts, monkeypatch, slices):
    monkeypatch.setattr(K, "SLICE_TERMS", slices)
    rng = random.Random(9)
    terms = ["okta", "alpha beta", "été", "X", "\\ma", "yz 1", "naïve"] + ["".join(rng.choice("abxyz") for _ in range(rng.randint(1, 9))) for _ in range(200)]
    dictionary = spark.createDataFrame([(t, k) for k, t in enumerate(terms)], "term string, rank int")
    df = spark.createDataFrame(texts, "id long, text string")
    out = E.dictionary_first_match(df, "text", dictionary, ["id"], out="hit")
    expected = {i: next((w for w in terms if w.lower() in (t or "").lower() and t is not None), None) for i, t in texts}
    assert {r.id: r.hit for r in out.collect()} == expected


def test_whole_words_of_a_large_dictionary(spark, texts):
    import re
    terms = ["okta", "alpha", "x", "yz", "a_b", "100%", "gam\\ma", "\\E", "été"] + [f"word{i}" for i in range(60)]
    dictionary = spark.createDataFrame([(t, t, "T") for t in terms], "term string, entity_name string, entity_type string")
    turns = spark.createDataFrame([(i, "s", t) for i, t in texts], "meeting_id long, speaker_name string, sentence string")
    got = {(r.meeting_id, r.entity_name) for r in E.dictionary_mentions(turns, dictionary).collect()}
    assert got == {(i, w) for i, t in texts for w in terms if t and re.search(rf"(?<!\w){re.escape(w.lower())}(?!\w)", t.lower())}


def test_words_meet_their_terms_in_a_join(spark, texts):
    """No text is listed by its runs for terms that are words."""
    dictionary = spark.createDataFrame([(f"Word{i}", f"w{i}", "T") for i in range(60)] + [("okta", "o", "T"), ("100%", "p", "T")],
                                       "term string, entity_name string, entity_type string")
    turns = spark.createDataFrame([(i, "s", t) for i, t in texts] + [(90, None, "word7 WORD8,word7")], "meeting_id long, speaker_name string, sentence string")
    out = E.dictionary_mentions(turns, dictionary)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "_word" in plan
    assert {tuple(r)[:3] for r in out.collect() if r.meeting_id == 90} == {(90, None, "w7"), (90, None, "w8")}
    assert {r.meeting_id for r in out.collect() if r.entity_name == "p"} == {i for i, t in texts if t and "100%" in t.split()}


def test_questions_of_every_conversation(spark, scratch):
    said = [(0, 0, "The end"), (1, 0, "The of"), (2, 0, "a b c d"), (3, 0, "of it and more"), (7, 0, "It and of%it no"),
            (100, 0, "of it"), (100, 1, "not asked"), (200, 0, "a b c"), (300, 0, None)]
    spark.createDataFrame(said, "conv_id long, turn long, text string").write.parquet(f"{scratch}/conversations.parquet")
    docs = [(1, "s", "the start\nof it and of%it"), (2, "s", "a_b_c"), (3, "s", None), (4, "s", "of\\it\\and\\more")]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{scratch}/documents.parquet")
    got = {(r.qid, r.meeting_id): r.score for r in all_queries()["alg6_search_many"].build(spark, scratch).collect()}
    assert got == {(0, 1): 11.0, (1, 1): 10.0, (2, 2): 11.0, (3, 4): 11.0, (100, 1): 11.0, (100, 4): 11.0,
                   (200, 1): 12.0, (200, 2): 11.0, (200, 4): 11.0}


def test_wildcards_take_time_linear_in_the_text(spark):
    """Parts that stand often, with a last one that is not there."""
    lines = spark.createDataFrame([(1, "ab" * 6000 + "!", "x")], "meeting_id long, sentence string, note string")
    asked = spark.createDataFrame([(1, "a%b%a%b%a%b%z"), (2, "a%b%a%B_!"), (3, "%"), (4, "b%!%")] + [(q, f"none%{q}") for q in range(10, 60)], "qid long, question string")
    assert sorted(r.qid for r in R._hits(lines, asked, "sentence").collect()) == [3, 4]


def test_a_text_is_gone_through_once_for_anchors_of_all_lengths(spark, texts):
    rng = random.Random(5)
    terms = ["", "é", "\x00", "a\x00"] + ["".join(rng.choice("abxy \n") for _ in range(1 + n % 7)) for n in range(60)]
    df = spark.createDataFrame(texts + [(83, "a\x00b"), (84, "bxy")], "id long, text string")
    asked = spark.createDataFrame([(k, t) for k, t in enumerate(terms)], "k int, term string")
    out = K.containing(df.withColumn("low", F.lower("text")), ["low"], asked, "term", lambda c: F.col(c).contains(F.col("term")))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    got = [(r.id, r.k) for r in out.select("id", "k").collect()]
    rows = {i: t.lower() for i, t in [*texts, (83, "a\x00b"), (84, "bxy")] if t is not None}
    assert len(got) == len(set(got))
    assert {g for g in got if g[0] != 80} == {(i, k) for i, t in rows.items() for k, w in enumerate(terms) if w in t}
