"""N-gram Jaccard join with a MinHash LSH forest.

Documents are sets of five-word shingles. Equal sets form a class at once and
go on as one. Each tree of the forest gives a class a label: a path of small
MinHash values, packed so that a shorter path is a right shift and sorted
labels are a prefix trie. Paths are shortened until the chance that a pair at
the threshold meets in some tree reaches the target recall; classes that meet
are candidates. Candidates are compared exactly, whole sets, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, components, emptied, keep, only_needed, row_key

SHINGLE = 5
THRESHOLD = 0.8
TREES = 16
DEPTH = 6
BITS = 10  # of one MinHash value in a label
RECALL = 0.995
# a verification task holds two blocks of about this size
BLOCK_SHINGLES = 1_500_000
BLOCK_DOCS = 400
CACHE_WORDS = 400_000

_rng = np.random.default_rng(20_240_501)
_MUL = (_rng.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)
_POWERS = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = got = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return got


_WORDS = _WordHashes()


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` lower-cased,
    blank-separated words; a shorter text with a word is one run."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.array(list(map(_WORDS.__getitem__, words)), dtype=np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(h.tobytes(), seed=len(words))], dtype=np.uint64)
    n = len(h) - size + 1
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        part = h[k:k + n] * _POWERS[k]
        out = (out ^ (part ^ (part >> np.uint64(31)))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out ^ (out >> np.uint64(32)))


def labels(hashes: np.ndarray) -> np.ndarray:
    """The path of each tree as one integer, first value highest."""
    least = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 2048):
        mixed = hashes[at:at + 2048] * _MUL[:, None] + _ADD[:, None]
        least = np.minimum(least, mixed.min(axis=1))
    least = (least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)  # a minimum's own high bits are mostly zero
    path = np.zeros(TREES, dtype=np.uint64)
    for level in least.reshape(TREES, DEPTH).T:
        path = (path << np.uint64(BITS)) | level
    return path.astype(np.int64)


def expected_recall(similarity: float, depth: int, trees: int = TREES) -> float:
    return 1 - (1 - similarity ** depth) ** trees


def prefix_depth(threshold: float, target: float = RECALL) -> int:
    """Longest prefix at which a pair at the threshold meets in some tree
    with the target probability, shortening from the full path."""
    depth = DEPTH
    while depth > 1 and expected_recall(threshold, depth) < target:
        depth -= 1
    return depth


def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    with emptied(_WORDS):
        for batch in batches:
            rows = []
            for uid, th, text in zip(batch["_uid"].tolist(), batch["_th"].tolist(), batch["text"].tolist()):
                s = shingles(text)
                h = int(np.int64(np.uint64(xxhash.xxh64_intdigest(s.tobytes())))) if len(s) else None
                rows.append((uid, th, h, len(s), labels(s).tolist() if len(s) else []))
            out = pd.DataFrame(rows, columns=["_uid", "_th", "h", "n", "labels"])
            yield out.astype({"h": "Int64"})


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Shared shingles of every pair, by products of 0/1 matrices over the
    shingles that occur more than once."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    values, where, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    some = times[where] > 1
    owner, column = owner[some], column[where[some]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((m, m), dtype=np.float32)
    width = 8192
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        grid = np.zeros((m, width), dtype=np.float32)
        grid[owner[a:b], column[a:b] - lo] = 1
        out += grid @ grid.T
    return out


def _verify(threshold: float):
    def verify(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """One pair of blocks of a candidate component (or one block with
        itself): for every class the copies it is similar to and the root of
        its group among these rows."""
        h = rows["h"].to_numpy()
        with emptied(_WORDS):
            sets = [shingles(t) for t in rows["text"].tolist()]
        size = np.array([len(s) for s in sets], dtype=np.float32)
        shared = _overlaps(sets)
        near = shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-4
        np.fill_diagonal(near, False)
        _, first, second = key
        if first != second:
            block = rows["block"].to_numpy()
            near &= block[:, None] != block[None, :]
        links = near @ rows["copies"].to_numpy(dtype=np.int64)
        root = np.arange(len(h))
        while True:  # smallest position reachable, by spreading minima
            reach = np.where(near, root[None, :], len(h)).min(axis=1, initial=len(h))
            new = np.minimum(root, reach)
            new = np.minimum(new, new[new])
            if (new == root).all():
                break
            root = new
        return pd.DataFrame({"h": h, "links": links, "root": h[root]})

    return verify


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``_uid, _th, h, root, copies, links`` per row of ``docs``:
    ``h`` its set of shingles (NULL without words), ``root`` its class,
    ``copies`` the rows with the same set and ``links`` the rows with another
    set at ``threshold`` or more."""
    slim = docs.select(*row_key(), F.col("text").cast("string").alias("text"))
    rows = keep(slim.mapInPandas(_signatures, "_uid long, _th long, h long, n int, labels array<long>"))
    classes = (rows.where("h IS NOT NULL").groupBy("h")
               .agg(F.count("*").alias("copies"), F.first("n").alias("n"), F.first("labels").alias("labels"),
                    F.min(F.struct("_uid", "_th")).alias("at")))
    classes = keep(classes)
    shift = BITS * (DEPTH - prefix_depth(threshold))
    nodes = classes.select("h", F.posexplode("labels").alias("tree", "label")).select(
        "h", "tree", F.shiftright("label", shift).alias("prefix"))
    hubs = nodes.groupBy("tree", "prefix").agg(F.min("h").alias("hub"), F.max("h").alias("other")).where("hub <> other")
    edges = nodes.join(hubs.drop("other"), ["tree", "prefix"]).select(F.col("h").alias("a"), F.col("hub").alias("b"))
    found = components(edges).join(classes.select(F.col("h").alias("node"), "n", "copies", "at"), "node")
    blocks = found.groupBy("comp").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES),
                                                  F.ceil(F.count("*") / BLOCK_DOCS)).cast("int").alias("blocks"))
    members = keep(found.join(blocks, "comp").select(
        F.col("node").alias("h"), "comp", "blocks", "copies", "at._uid", "at._th",
        F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("blocks").cast("long")).cast("int").alias("block")))
    texts = only_needed(slim, members.select("_uid", "_th", "h"), ["_uid", "_th"]).select("h", "text")
    # repeats of one row bring the same text twice; the first of a class is enough
    paired = (members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("h", "comp", "block", "copies", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2")))
    checked = keep(paired.join(texts.dropDuplicates(["h"]), "h").groupBy("comp", "b1", "b2")
                   .applyInPandas(_verify(threshold), "h long, links long, root long"))
    links = checked.groupBy("h").agg(F.sum("links").alias("links"))
    roots = components(checked.select(F.col("h").alias("a"), F.col("root").alias("b")))
    return (rows.select("_uid", "_th", "h")
            .join(classes.select("h", "copies"), "h", "left").join(links, "h", "left")
            .join(roots.select(F.col("node").alias("h"), F.col("comp").alias("root")), "h", "left")
            .select("_uid", "_th", "h", F.coalesce("root", "h").alias("root"), "copies", F.coalesce("links", F.lit(0)).alias("links")))


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Near-duplicate classes of ``docs(doc_id, text, ...)``: one row per
    document, ``doc_id, class_id, n_links``.

    ``class_id`` is the smallest id of the documents connected by links,
    ``n_links`` the number of other documents with a Jaccard similarity of at
    least ``threshold`` over five-word shingles. Documents with equal sets are
    linked; a text of one to four words is one shingle; NULL and empty texts
    have none and stand alone. NULL ids are listed and count as links but
    never name a class unless all its ids are NULL.
    """
    out = jaccard_classes(docs, threshold)
    ident = F.when(F.col("_uid") == NO_ID, None).otherwise(F.col("_uid"))
    named = out.where("root IS NOT NULL").groupBy("root").agg(F.min(ident).alias("class_id"))
    return (out.join(named, "root", "left")
            .select(ident.cast(docs.schema["doc_id"].dataType).alias("doc_id"),
                    F.when(F.col("h").isNull(), ident).otherwise(F.col("class_id")).cast(docs.schema["doc_id"].dataType).alias("class_id"),
                    F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0)).alias("n_links")))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest id,
    one without id only if all are (of repeated rows, one). Documents without words stay, one of each id."""
    out = jaccard_classes(docs, threshold)
    order = F.struct((F.col("_uid") == NO_ID).alias("no_id"), "_uid", "_th")
    first = out.where("root IS NOT NULL").groupBy("root").agg(F.min(order).alias("at"))
    chosen = first.select("at._uid", "at._th").unionByName(out.where("root IS NULL").select("_uid", "_th").distinct())
    keyed = docs.select(*row_key(), *[F.col(c).alias(f"in_{c}") for c in docs.columns])
    return (keyed.join(chosen, ["_uid", "_th"]).dropDuplicates(["_uid", "_th"])
            .select(*[F.col(f"in_{c}").alias(c) for c in docs.columns]))
