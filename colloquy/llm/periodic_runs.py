"""Periodic runs of words by maximal-pair enumeration.

A maximal pair is two places of a text where the same words stand, which
differ in the word before and in the word after. A pair at distance q that
agrees over l >= q words is a run of period q and length l + q, and every run
is such a pair: nothing has to be extended.

The suffixes of a text are sorted by doubling, and the LCP-interval tree is
built bottom-up over the common lengths of neighbours. Each interval holds its
places, also listed by the word to their left. When two intervals join at
depth l, every place of the smaller is paired with the places of the larger at
most l away whose left word is another one. Suffixes that agree in less than
half the least length are never joined, so only texts in which six words
repeat are sorted at all.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 12  # words of a run
# words sorted at a time; a longer text is sorted alone
BATCH_WORDS = 1 << 19

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self) + 1
        return code


def _with_repeats(codes: np.ndarray, text: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the texts in which ``size`` words in a row may occur twice
    (told by hashes; a few others may be among them)."""
    x = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    h = text.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for k in range(size):
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h[: len(x) - k] += x[k:]
        h ^= h >> np.uint64(29)
    order = np.argsort(h)
    h = h[order]
    return np.unique(text[order[1:][h[1:] == h[:-1]]])


def suffixes(codes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``places, common``: the places in the order of their suffixes, and how
    many words each suffix shares with the one before. Every text ends with a
    code of its own (0), so nothing is shared beyond an end or between texts."""
    n = len(codes)
    _, first, inverse, counts = np.unique(text.astype(np.int64) * (int(codes.max()) + 1) + codes,
                                          return_index=True, return_inverse=True, return_counts=True)
    starts = np.cumsum(counts) - counts
    rank = starts[inverse].astype(np.int32)  # place of a group's first suffix in the order
    open_ = np.flatnonzero(counts[inverse] > 1)  # suffixes not told apart yet
    levels, width = [rank], 1
    while len(open_):
        after = rank[np.minimum(open_ + width, n - 1)].astype(np.int64)
        key = rank[open_].astype(np.int64) * n + after
        order = np.argsort(key)
        open_, key = open_[order], key[order]
        group = rank[open_]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        head = np.concatenate([[True], group[1:] != group[:-1]])
        at = np.arange(len(open_))
        offset = np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(head, at, 0))
        rank = rank.copy()
        rank[open_] = group + offset
        last = np.append(new[1:], True)
        open_ = open_[~(new & last)]
        levels.append(rank)
        width *= 2
    places = np.empty(n, np.int32)
    places[rank] = np.arange(n, dtype=np.int32)
    common, a, b = np.zeros(n, np.int32), places[:-1].copy(), places[1:].copy()
    for k in range(len(levels) - 2, -1, -1):
        same = levels[k][a] == levels[k][b]
        step = np.where(same, 1 << k, 0).astype(np.int32)
        common[1:] += step
        a, b = a + step, b + step
    return places, common


def _join(one, other, depth: int, left: list[int], least: int, pairs: list) -> tuple:
    """Of two intervals ``(places, places by left word)`` joining at ``depth``:
    note the maximal pairs at most ``depth`` apart, put the smaller into the
    larger."""
    (big, by), (small, _) = (one, other) if len(one[0]) >= len(other[0]) else (other, one)
    for j in small:
        low, high = bisect_left(big, j - depth), bisect_right(big, j + depth)
        if low == high:
            continue
        own = by.get(left[j], ())
        if high - low == bisect_right(own, j + depth) - bisect_left(own, j - depth):
            continue
        if high - low <= len(by):
            near = [i for i in big[low:high] if left[i] != left[j]]
        else:
            near = [i for word, at in by.items() if word != left[j]
                    for i in at[bisect_left(at, j - depth):bisect_right(at, j + depth)]]
        pairs += [(i, j, depth) if i < j else (j, i, depth) for i in near if depth + abs(i - j) >= least]
    for j in small:
        insort(big, j)
        insort(by.setdefault(left[j], []), j)
    return big, by


def maximal_pairs(places: np.ndarray, common: np.ndarray, left: list[int], least: int) -> list[tuple[int, int, int]]:
    """``(i, j, depth)`` of all maximal pairs with ``j - i <= depth`` and
    ``depth + j - i >= least``."""
    deep = -(-least // 2)  # l >= q and l + q >= least
    pairs: list[tuple[int, int, int]] = []
    stack: list[tuple[int, tuple]] = []  # intervals, each with the depth at which it joins the one below

    def close(depth: int) -> None:
        while len(stack) > 1 and stack[-1][0] > depth:
            at, top = stack.pop()
            under, below = stack.pop()
            stack.append((under, _join(below, top, at, left, least, pairs)))

    leaf = lambda p: ([p], {left[p]: [p]})
    deeper = np.flatnonzero(common >= deep)
    for k, p, before, depth in zip(deeper.tolist(), places[deeper].tolist(), places[deeper - 1].tolist(), common[deeper].tolist()):
        if not stack or last != k - 1:
            close(0)
            stack = [(0, leaf(before))]
        close(depth)
        stack.append((depth, leaf(p)))
        last = k
    close(0)
    return pairs


def runs_of(texts: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """Of each text, a list of words: ``(start, length, period)`` of its runs,
    by start and period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    some = [k for k, words in enumerate(texts) if len(words) >= least]
    if not some:
        return found
    ids = _Codes()
    own = [np.fromiter(map(ids.__getitem__, texts[k]), np.int32, len(texts[k])) for k in some]
    end = np.zeros(1, np.int32)
    joined = lambda ks: (np.concatenate([x for k in ks for x in (own[k], end)]),
                         np.repeat(np.arange(len(ks), dtype=np.int32), [len(own[k]) + 1 for k in ks]))
    ks = _with_repeats(*joined(range(len(some))), -(-least // 2)).tolist()
    if not ks:
        return found
    codes, text = joined(ks)
    places, common = suffixes(codes, text)
    left = [0, *codes[:-1].tolist()]  # before a text stands an end, the same word nowhere else
    starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])).tolist()
    shortest: list[dict[tuple[int, int], int]] = [{} for _ in ks]
    of = text.tolist()
    for i, j, depth in maximal_pairs(places, common, left, least):
        t = of[i]
        # multiples of a run's period are pairs of the same stretch
        stretch = (i - starts[t], depth + j - i)
        if shortest[t].get(stretch, stretch[1]) > j - i:
            shortest[t][stretch] = j - i
    for k, stretches in zip(ks, shortest):
        found[some[k]] = sorted(((s, length, q) for (s, length), q in stretches.items()), key=lambda r: (r[0], r[2]))
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside every run's repeats, joined by one space."""
    if runs:
        edges = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            edges[start + period] += 1
            edges[start + length] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]
    return b" ".join(words)


def _found(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    names = ["id", "n_words", "runs", "collapsed"]
    for batch in batches:
        done = 0
        texts, words = [], 0

        def flush() -> pa.RecordBatch:
            runs = runs_of(texts, least)
            return pa.RecordBatch.from_arrays([
                batch.column(0).slice(done, len(texts)), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in runs], RUNS),
                pa.array([collapsed(t, rs) for t, rs in zip(texts, runs)], pa.binary()).cast(pa.string())], names)

        for k in range(batch.num_rows):
            own = (batch.column(1)[k].as_py() or "").encode().split()  # blanks: tab to carriage return and space
            if texts and words + len(own) > BATCH_WORDS:
                yield flush()
                done, texts, words = k, [], 0
            texts.append(own)
            words += len(own)
        if texts:
            yield flush()


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``<id_col>, n_words, runs, collapsed`` per row: the maximal stretches of
    ``least`` words or more, and at least twice their smallest period, as
    ``array<struct<start, length, period>>`` by start and period; and the text
    without what repeats in them, words joined by one space.

    NULL and empty texts have no words, no runs and an empty rest. Repeated
    rows get the same result, an empty table gives no rows. A text is worked
    on whole, by one task. Other columns, whatever their names, are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["id"]
    out = rows.mapInArrow(lambda batches: _found(batches, least),
                          f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return out.withColumnRenamed("id", id_col)
