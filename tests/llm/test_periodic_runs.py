"""Runs against the definition, period by period; the query against a plain
reading of its contract."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.llm import periodic_runs, queries


def brute(words, least=12):
    """Each period's maximal stretches, kept where no smaller period fits."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            e = i
            while e + q < n and words[e] == words[e + q]:
                e += 1
            start, length = i, e - i + q
            stretch = words[start:start + length]
            if length >= max(least, 2 * q) and not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                out.append((start, length, q))
            i = e
    return sorted(out, key=lambda r: (r[0], r[2]))


def rest(words, runs):
    return b" ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in runs))


def periodic(rng, n):
    words = [b"w%d" % rng.randrange(30) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        a, p = rng.randrange(n), rng.randint(1, 9)
        m = rng.randint(1, 40)
        words[a:a + m] = [words[a:a + p][k % len(words[a:a + p])] for k in range(m)]
    return words


def test_equals_definition():
    rng = random.Random(5)
    texts = [periodic(rng, rng.randint(1, 90)) for _ in range(400)]
    texts += [[b"a"] * n for n in (11, 12, 13, 60)] + [[b"a", b"b"] * 20, [b"a", b"a", b"b"] * 9 + [b"a"], [], [b"x"]]
    texts += [[rng.choice([b"a", b"b"]) for _ in range(120)] for _ in range(60)]
    fib = [b"a"]
    prev = [b"b"]
    for _ in range(8):
        fib, prev = fib + prev, fib
    texts += [fib, fib + fib]
    for words, runs in zip(texts, periodic_runs.runs_of(texts)):
        assert runs == brute(words), words
        assert periodic_runs.collapsed(words, runs) == rest(words, runs)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60), st.integers(2, 14))
def test_any_text_any_least_length(words, least):
    assert periodic_runs.runs_of([words, words[::-1]], least) == [brute(words, least), brute(words[::-1], least)]


def test_suffixes_are_sorted():
    rng = np.random.default_rng(2)
    text = np.repeat([0, 1], [40, 61]).astype(np.int32)
    codes = rng.integers(1, 3, 101).astype(np.int32)
    codes[[39, 100]] = 0
    places, common = periodic_runs.suffixes(codes, text)
    whole = [(int(text[p]), codes[p:40 if p < 40 else 101].tolist()) for p in places]
    assert whole == sorted(whole)
    for k in range(1, len(places)):
        (s, a), (t, b) = whole[k - 1], whole[k]
        m = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) if s == t else 0
        assert common[k] == m


def planted(doc_id, text):
    words = re.findall("[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return [w.encode() for w in words]


def expected(doc_id, text):
    words = planted(doc_id, text)
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    told = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, digest(told.encode()), digest(rest(words, runs)))


def test_query_equals_contract(spark, make, monkeypatch):
    rng = random.Random(8)
    rows = [(i, " ".join(w.decode() for w in periodic(rng, rng.randint(1, 70)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, " \t\n "), (None, "x " * 30), (None, None), (903, "tab\tbed\r\nwords\x0b" * 9),
             (904, "é\xa0b é\xa0b " * 12), rows[3], rows[3], (905, " ".join(["ab", "cd", "ef"] * 2000))]
    docs = make(rows).repartition(3)
    monkeypatch.setattr(queries, "read", lambda *_: docs)
    out = queries.op13_periodic_runs(spark, "")
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: str(tuple(r))
    small = [r for r in rows if r[0] != 905]
    assert sorted((tuple(r) for r in out.collect() if r.doc_id != 905), key=key) == sorted((expected(*r) for r in small), key=key)
    (long,) = [r for r in out.collect() if r.doc_id == 905]
    if zlib.crc32(b"905") % 10:
        assert (long.n_runs, long.start, long.length, long.period) == (1, 0, 6000, 3)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(300)) > 10


def test_empty_table_and_texts(make):
    assert periodic_runs.find_runs(make([])).collect() == []
    (row,) = periodic_runs.find_runs(make([(1, None)])).collect()
    assert tuple(row) == (1, 0, [], "")
