"""Exact dedup by digest history against a plain dictionary, and the hash
itself: minimal, perfect, and nonmembers told by their bytes."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np

from colloquy.llm import digest_history


def normal(text):
    return re.sub("[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    """(doc_id, keep_id, group_size, sha256) -> number of rows, and of kept ones."""
    groups = defaultdict(list)
    for i, text in rows:
        groups[normal(text)].append(i)
    out = defaultdict(lambda: [0, 0])
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        for place, i in enumerate(ids):
            entry = out[i, ids[0], len(ids), hashlib.sha256(text.encode()).hexdigest()]
            entry[0] += 1
            entry[1] += place == 0
    return dict(out)


def found(df):
    out = defaultdict(lambda: [0, 0])
    for r in df.collect():
        entry = out[r.doc_id, r.keep_id, r.group_size, r.text_sha256]
        entry[0] += 1
        entry[1] += r.kept
    return dict(out)


def rows_of(seed, n=400):
    rng = random.Random(seed)
    texts = [f"text {k}  of\tmany" + " long" * rng.randrange(3) for k in range(n // 3)]
    rows = [(i, rng.choice(texts)) for i in range(n)]
    rows += [(i, "the copy of a third") for i in range(n, n + n // 2)]  # a hot text
    rows += [(5000, None), (5001, ""), (None, ""), (None, "no id"), (None, "no id"), (5002, " \t\r\n\v\f "), (5003, " "),
             (5004, "a b"), (5005, "a\n\tb"), (5006, "a b"), (5007, "a b "), (-3, "a \v b"), (5008, "x " * 200_000), (-9, "x\n" * 200_000),
             rows[3], rows[3], (5004, "a b")]
    rng.shuffle(rows)
    return rows


def test_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 5000):
        words = rng.integers(0, 1 << 63, (n, digest_history.WORDS), dtype=np.int64).astype(np.uint64)
        words[: n // 2, :3] = 7  # told apart by the last word only
        sizes, levels, slots = digest_history.build_hash(words)
        assert sorted(slots) == list(range(n))
        assert (digest_history.find_slots(words, sizes, levels) == slots).all()


def test_equals_brute_force(make):
    rows = rows_of(1)
    docs = make(rows).repartition(5)
    out = digest_history.exact_dedup(docs)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "in_history"]
    assert found(out) == brute(rows)
    # both ways are taken: digests of the history, and groups outside it
    assert {r.in_history for r in out.collect()} == {True, False}


def test_many_shards(make, monkeypatch):
    monkeypatch.setattr(digest_history.build_history, "__defaults__", (16,))
    rows = rows_of(2, 150)
    assert found(digest_history.exact_dedup(make(rows).repartition(3))) == brute(rows)


def test_empty_tables_and_null_ids(make):
    assert digest_history.exact_dedup(make([])).collect() == []
    rows = [(None, "a"), (None, "a"), (None, None)]
    assert found(digest_history.exact_dedup(make(rows))) == brute(rows)


def test_later_table_against_an_earlier_history(make):
    first, second = make([(7, "one"), (9, "two"), (8, "one")]), make([(1, "one"), (2, "three"), (3, "three"), (4, None)])
    index = digest_history.build_history(digest_history.numbered_digests(first))
    out = {(r.doc_id, r.keep_id, r.group_size, r.kept, r.in_history) for r in digest_history.exact_dedup(second, index).collect()}
    assert out == {(1, 7, 1, False, True), (2, 2, 2, True, False), (3, 2, 2, False, False), (4, 4, 1, True, False)}
    # the next history holds the winners of both tables
    news = digest_history.numbered_digests(second)
    both = digest_history.build_history(digest_history.slots(index).unionByName(
        news.select("digest", "no_id", "id", "row").join(digest_history.slots(index), "digest", "left_anti")))
    again = digest_history.exact_dedup(second, both)
    assert {r.doc_id for r in again.collect() if r.kept} == set()
    assert all(r.in_history for r in again.collect())
