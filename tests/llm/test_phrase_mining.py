"""Collocations against plain counting of all phrases, over many shards."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np

from colloquy.llm import phrase_mining

COLS = "doc_id long, text string, lang string, n long, phrase string, words string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i:i + k])] += 1
    out = []
    for lang in n:
        c = f[lang]
        cand = [p for p, a in c.items() if 2 <= len(p) <= 5 and a >= least]
        inside = {q[i:j] for q in cand for i in range(len(q)) for j in range(i + 2, len(q) + 1)
                  if j - i < len(q) and c[q] >= c[q[i:j]]}
        best = []
        for p in cand:
            if p not in inside:
                score, k = min((1000 * c[p] * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -c[p], " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def texts(seed, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["Éa", "ÀB", "x\x1cy", "n o", "日本", "-", "Big"]
    fixed = ["new york city hall tower", "of the end", "Big apple", "a a a a a a"]
    rows = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(5, 80)):
            words += [rng.choice(vocab)] if rng.random() < 0.7 else rng.choice(fixed).split()
        rows.append((" ".join(w + rng.choice(["", "", "", ".", ",", ";", "!\n", "\r", "\t", "\x0b"]) for w in words), rng.choice(["en", "en", "de", None, ""])))
    # a common word pair in a third of the texts, repeated rows, nulls and blanks
    rows += [("hot pair " * 30, "en")] * (n // 3) + [(None, "en"), ("", None), (" \t. ,", "fr"), ("alone", "it"), ("deep " * 50_000, "es")]
    return rows


def frame(spark, rows, parts=7):
    return spark.createDataFrame([(i, t, g, 1, "p", "w") for i, (t, g) in enumerate(rows)], COLS).repartition(parts)


def found(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


def test_equals_brute_force_over_many_shards(spark, monkeypatch):
    rows = texts(1)
    monkeypatch.setattr(phrase_mining, "SHARDS", 1)
    for least, top in ((6, 5000), (25, 4)):
        assert found(phrase_mining.collocations(frame(spark, rows), least, top, shard_words=800)) == brute(rows, least, top)


def test_one_shard_and_empty_table(spark):
    rows = texts(2, 40)
    assert found(phrase_mining.collocations(frame(spark, rows), 9)) == brute(rows, 9, 2000)
    assert found(phrase_mining.collocations(frame(spark, []))) == []
    assert found(phrase_mining.collocations(frame(spark, [(None, None), ("", "en")]))) == []


def test_full_bitmap_changes_nothing():
    """Phrases let through by the bitmap alone are counted exactly."""
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 6, 4000).astype(np.int32)
    hashes = rng.integers(0, 1 << 62, 6).astype(np.uint64)
    every = np.full(1 << (phrase_mining.UNION_BITS - 3), 255, np.uint8)
    for k, places, counts, _ in phrase_mining.phrases(codes, hashes, 1, every):
        plain = Counter(w for w in (tuple(codes[i:i + k]) for i in range(len(codes) - k + 1)) if 0 not in w)
        assert {tuple(codes[p:p + k]): c for p, c in zip(places, counts)} == plain


def test_products_beyond_64_bits(spark, monkeypatch):
    """a n passes 64 bits: the quotient is still exact."""
    big = 3_000_000_007
    monkeypatch.setattr(phrase_mining, "phrase_counts", lambda *a: (
        spark.createDataFrame([("en", 10 * big)], "lang string, n long"),
        spark.createDataFrame([("en", "x", 2 * big + 1), ("en", "y", 3 * big), ("en", "x y", big)], "lang string, phrase string, f long")))
    (row,) = phrase_mining.collocations(None).collect()
    assert row.score == 1000 * big * 10 * big // ((2 * big + 1) * 3 * big)


def test_candidates_do_not_grow_with_the_shards(spark):
    """More shards than the support: no phrase is a candidate for standing in one of them."""
    rng = random.Random(8)
    rows = [(" ".join(f"w{rng.randrange(300)}" for _ in range(400)) + ". of the end. " * 2, "en") for _ in range(40)]
    chunks = phrase_mining.encoded_words(frame(spark, rows, 40))
    n = sum(r.n for r in chunks.select("n").collect())
    union = phrase_mining.candidates(chunks, n, 30, shard_words=100)
    f = Counter()
    for text, _ in rows:
        for piece in text.split("."):
            w = piece.split()
            f.update(tuple(w[i:i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    frequent = sum(c >= 30 for c in f.values())
    assert len(rows) > 30 and sum(c < 30 for c in f.values()) > 40_000
    assert frequent - 2 <= np.unpackbits(union).sum() <= frequent + 2
