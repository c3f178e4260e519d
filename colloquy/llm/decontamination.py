"""Benchmark decontamination by q-gram lemma filtering.

A region within edit distance ``k`` of a benchmark item of ``m`` characters
shares at least ``m - q + 1 - k * q`` q-grams with it, all on diagonals (text
position minus item position) at most ``k`` apart. Shared q-grams are counted
per item in diagonal bands of width ``2 (k + 1)`` that overlap by half, so any
such set of diagonals lies whole in one band. Regions that reach the bound
are verified by alignment within the band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Q = 10
EDIT_RATE = 0.08
# q-grams of the benchmark sent to the executors at a time; a larger benchmark
# is compared slice by slice
SLICE_CHARS = 4_000_000
SLOTS = 1 << 22
CHUNK_CHARS = 1 << 20

_BASE = 0x9E3779B97F4A7C15


def normalise(text: str | None) -> str:
    """Lower case, every run of white space one blank."""
    return " ".join(text.lower().split()) if text else ""


def edit_budget(length: int, q: int = Q, rate: float = EDIT_RATE) -> int:
    """Edits allowed for an item: ``rate`` of its characters, but never so
    many that the bound on shared q-grams falls under one."""
    return max(0, min(int(rate * length), (length - q) // q))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def qgram_hashes(points: np.ndarray, q: int = Q) -> np.ndarray:
    """64-bit hash of each window of ``q`` code points, by doubling."""
    n = len(points) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, have, power, width, base = None, 0, points + np.uint64(1), 1, _BASE
    rest = q
    while rest:  # power holds hashes of windows of `width`; take it where q has that bit
        mult = np.uint64(pow(base, width, 1 << 64))
        if rest & 1:
            if out is None:
                out, have = power, width
            else:
                keep = len(out) - width
                out = out[:keep] * mult + power[have:have + keep]
                have += width
        rest >>= 1
        if rest:
            power = power[:-width] * mult + power[width:]
            width *= 2
    out = out[:n]
    return out ^ (out >> np.uint64(29))


class BenchmarkIndex:
    """q-grams of normalised items, sorted by hash."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, rate: float = EDIT_RATE):
        self.q = q
        self.items = [(i, t) for i, t in items if len(t) >= q]
        self.length = np.array([len(t) for _, t in self.items], dtype=np.int64)
        self.budget = np.array([edit_budget(len(t), q, rate) for _, t in self.items], dtype=np.int64)
        self.bound = self.length - q + 1 - self.budget * q
        hashes, item, pos = [], [], []
        for k, (_, text) in enumerate(self.items):
            h = qgram_hashes(codes(text), q)
            hashes.append(h)
            item.append(np.full(len(h), k, dtype=np.int64))
            pos.append(np.arange(len(h), dtype=np.int64))
        joined = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        order = np.argsort(joined, kind="stable")
        self.hash = joined[order]
        self.item = np.concatenate(item)[order] if item else np.zeros(0, dtype=np.int64)
        self.pos = np.concatenate(pos)[order] if pos else np.zeros(0, dtype=np.int64)
        self.slot = np.zeros(SLOTS, dtype=bool)
        self.slot[(self.hash & np.uint64(SLOTS - 1)).astype(np.int64)] = True

    def hits(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text position, item and item position of each shared q-gram."""
        found, low, high = [], [], []
        for at in range(0, max(0, len(points) - self.q + 1), CHUNK_CHARS):
            h = qgram_hashes(points[at:at + CHUNK_CHARS + self.q - 1], self.q)
            some = np.flatnonzero(self.slot[(h & np.uint64(SLOTS - 1)).astype(np.int32)])
            left = np.searchsorted(self.hash, h[some], side="left")
            right = np.searchsorted(self.hash, h[some], side="right")
            real = right > left
            found.append(some[real] + at)
            low.append(left[real])
            high.append(right[real])
        if not found:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        at, left, right = map(np.concatenate, (found, low, high))
        n = right - left
        entry = np.repeat(left - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return np.repeat(at, n), self.item[entry], self.pos[entry]


def banded_distance(pattern: np.ndarray, text: np.ndarray, low: int, budget: int) -> tuple[int, int]:
    """Least edits that turn ``pattern`` into some substring of ``text`` along
    the ``2 (budget + 1)`` diagonals from ``low`` on, and the end of that
    substring. Only the cells of these diagonals are computed: cell ``d`` of
    row ``i`` stands at text position ``low + d + i``. More than ``budget``
    edits are reported as ``budget + 1``."""
    width = 2 * (budget + 1)
    none = budget + 1
    ramp = np.arange(width)
    place = low + ramp
    # the characters under the band; a code no text has stands for places outside
    first, last = low, low + width + len(pattern) - 1
    under = np.full(last - first, np.iinfo(np.uint64).max, dtype=np.uint64)
    a, b = max(first, 0), min(last, len(text))
    if a < b:
        under[a - first:b - first] = text[a:b]
    row = np.where((place >= 0) & (place <= len(text)), 0, none)  # the match may begin anywhere
    for i, c in enumerate(pattern):
        step = row + (under[i:i + width] != c)
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)  # a character of the pattern left out
        place += 1
        if place[0] < 0 or place[-1] > len(text):
            step[(place < 0) | (place > len(text))] = none
        row = np.minimum(np.minimum.accumulate(step - ramp) + ramp, none)  # characters of the text left out
        if place[-1] > len(text):
            row[place > len(text)] = none
        if row.min() >= none:
            return none, 0
    end = int(row.argmin())
    return int(row[end]), int(place[end])


def find_regions(index: BenchmarkIndex, texts: list[str]) -> list[tuple[int, int, int, int, int, int]]:
    """Verified regions in normalised texts: text number, item number, start,
    end, shared q-grams, edits; the best region of each diagonal band group."""
    q = index.q
    gap = "\0" * q
    starts = np.cumsum([0] + [len(t) + q for t in texts])[:-1]
    points = codes(gap.join(texts)) if texts else np.zeros(0, dtype=np.uint64)
    at, item, pos = index.hits(points)
    if not len(at):
        return []
    doc = np.searchsorted(starts, at, side="right") - 1
    diagonal = at - starts[doc] - pos + index.length[item]  # never negative
    width = index.budget[item] + 1
    band = diagonal // width
    # each q-gram falls in two overlapping bands: [b, b + 1] and [b - 1, b]
    keys = np.stack([np.concatenate([doc, doc]), np.concatenate([item, item]),
                     np.concatenate([band, band - 1])])
    grams = np.concatenate([pos, pos])
    order = np.lexsort((grams, keys[2], keys[1], keys[0]))
    keys, grams = keys[:, order], grams[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
    first = new.copy()
    first[1:] |= grams[1:] != grams[:-1]  # a q-gram of the item counts once in a band
    begin = np.flatnonzero(new)
    shared = np.add.reduceat(first.astype(np.int64), begin)
    enough = shared >= index.bound[keys[1][begin]]
    out: dict[tuple[int, int, int], tuple[int, int, int, int, int, int]] = {}
    for g in np.flatnonzero(enough):
        d, k, b = (int(x) for x in keys[:, begin[g]])
        m, budget = int(index.length[k]), int(index.budget[k])
        low = b * (budget + 1) - m
        name, text = index.items[k][1], texts[d]
        exact = text.find(name, max(0, low), max(0, low + 2 * (budget + 1) - 1 + m))
        if exact >= 0:
            edits, start, end = 0, exact, exact + m
        else:
            lo = max(0, low)
            edits, end = banded_distance(codes(name), codes(text[lo:max(0, low + 2 * (budget + 1) + m)]), low - lo, budget)
            if edits > budget:
                continue
            end += lo
            start = max(0, end - m)
        old = out.get((d, k, end))
        if old is None or edits < old[5]:
            out[(d, k, end)] = (d, k, start, end, int(shared[g]), edits)
    return sorted(out.values())


def _slices(benchmark: DataFrame, q: int, rate: float, chars: int) -> Iterator[BenchmarkIndex]:
    """Indexes over consecutive items of about ``chars`` characters; the
    driver holds one slice at a time."""
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("i"),
                                F.col("text").cast("string").alias("t")).toLocalIterator():
        text = normalise(row["t"])
        if held and size + len(text) > chars:
            yield BenchmarkIndex(held, q, rate)
            held, size = [], 0
        held.append((row["i"], text))
        size += len(text)
    if held:
        yield BenchmarkIndex(held, q, rate)


def contaminated_regions(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE,
                         slice_chars: int = SLICE_CHARS) -> DataFrame:
    """Regions of ``docs(doc_id, text, ...)`` within the edit budget of an
    item of ``benchmark(item_id, text)``: ``doc_id, item_id, start, end,
    shared_qgrams, edits``; offsets are into the normalised text.

    Texts and items are compared in lower case with white space collapsed.
    NULL and empty texts hold nothing; items of fewer than ``q`` characters
    are too short to be evidence and match nothing; an empty benchmark gives
    no rows; repeated rows each give their regions. A benchmark of any size
    is compared in slices of ``slice_chars`` characters.
    """
    spark = docs.sparkSession
    out = spark.createDataFrame([], "doc_id string, item_id long, start int, end int, shared_qgrams int, edits int")
    slim = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for index in _slices(benchmark, q, rate, slice_chars):
        if not index.items:
            continue
        sent = spark.sparkContext.broadcast(index)

        def scan(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            idx = sent.value
            for batch in batches:
                ids = batch["doc_id"].tolist()
                texts = [normalise(t) for t in batch["text"].tolist()]
                rows = []
                for lo, hi in _portions(texts):
                    rows += [(ids[lo + d], idx.items[k][0], s, e, n, x)
                             for d, k, s, e, n, x in find_regions(idx, texts[lo:hi])]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "start", "end", "shared_qgrams", "edits"])

        out = out.unionByName(slim.mapInPandas(scan, out.schema))
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def _portions(texts: list[str], chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``chars`` characters together."""
    lo = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > chars:
            yield lo, i
            lo, size = i, 0
        size += len(text)
    if lo < len(texts):
        yield lo, len(texts)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``docs`` without the documents that hold a contaminated region; all
    columns are kept. Only the text goes through Python, so no join is needed
    and rows with a NULL id are judged like any other."""
    spark = docs.sparkSession
    for index in _slices(benchmark, settings.get("q", Q), settings.get("rate", EDIT_RATE),
                         settings.get("slice_chars", SLICE_CHARS)):
        if not index.items:
            continue
        leaks = _leaks(spark.sparkContext.broadcast(index))
        docs = docs.where(~leaks(F.col("text").cast("string")))
    return docs


def _leaks(sent):
    @F.pandas_udf("boolean")
    def leaks(text: pd.Series) -> pd.Series:
        texts = [normalise(t) for t in text.tolist()]
        out = np.zeros(len(texts), dtype=bool)
        for lo, hi in _portions(texts):
            for region in find_regions(sent.value, texts[lo:hi]):
                out[lo + region[0]] = True
        return pd.Series(out)

    return leaks
