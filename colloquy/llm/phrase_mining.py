"""Collocations by partitioned frequent-phrase mining in two passes.

The first pass finds candidates. The words of each language are dealt into
shards, and the shards are mined together, level by level: each counts its
phrases of k words, the counts are added up by the hash of the phrase, and only
phrases whose first and last k - 1 words reached the support are looked at. The
support is held against the sums, so what a shard lists does not grow with the
number of shards, as it would at a support lowered to the shard's share of the
words (one occurrence, beyond as many shards as the support). The second pass
counts all candidates in every shard, and the sums of the exact counts decide.

The candidates are a bitmap of fixed size over phrase hashes. Phrases that share
a hash have their counts added, so none that reaches the support is missed; one
that does not, but shares a bit, is counted in every shard as well and fails on
its exact count, so the result does not depend on the bitmap. A shard is as
large as a worker's memory allows (``shard_words``) and is what one task reads,
without a shuffle of texts. The sums are dealt by hash into parts that hold as
many phrases as a task can take, and a shard sends one row a part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_shuffles, keep

MAX_WORDS = 5
MIN_COUNT = 100
TOP = 2000
NO_LANG = "und"
# words a worker encodes at a time, and words of a shard at most; the passes
# hold some 60 bytes for each word of a shard
CHUNK_WORDS = 1 << 18
SHARD_WORDS = 3 << 19
# the sums are dealt by hash into so many parts; more only when a part could
# get more phrases than that
SHARDS, PART_PHRASES = 32, 1 << 22
# bits of the candidates' bitmap (16 MB)
UNION_BITS = 27

# A to Z is lowered by bytes.lower(); what ends a piece becomes a full stop,
# which no word can hold
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_PIECES = bytes.maketrans(ENDS, b"." * len(ENDS))
BREAK = 0  # code between pieces


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def encode(texts: list[str]) -> tuple[bytes, np.ndarray]:
    """``words, codes``: the distinct words joined by spaces, numbered from 1,
    and the words of the texts as such numbers with ``BREAK`` between pieces."""
    codes = _Codes({b".": BREAK})
    tokens = ".".join(texts).encode().lower().translate(_PIECES).replace(b".", b" . ").split()
    out = np.fromiter(map(codes.__getitem__, tokens), np.int32, len(tokens))
    return b" ".join(list(codes)[1:]), out


def _width(numbers: int) -> type:
    """What the codes of a chunk with so many different words are written in."""
    return np.uint16 if numbers <= 1 << 16 else np.int32


def _read(hashes: bytes, codes: bytes) -> tuple[np.ndarray, np.ndarray]:
    own = np.frombuffer(hashes, np.uint64)
    return own, np.frombuffer(codes, _width(len(own)))


def _encoded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows ``lang, n, words, hashes, codes``, each of some ``CHUNK_WORDS`` words."""
    waiting: dict[str, list[str]] = {}
    length: dict[str, int] = {}

    def flush(lang: str) -> Iterator[pd.DataFrame]:
        del length[lang]
        words, codes = encode(waiting.pop(lang))
        if n := int((codes != BREAK).sum()):
            seed = xxhash.xxh64_intdigest(lang.encode())
            # 0 is what stands between pieces
            own = np.array([0] + [xxhash.xxh64_intdigest(w, seed) or 1 for w in words.split(b" ")], np.uint64)
            yield pd.DataFrame({"lang": [lang], "n": [n], "words": [words], "hashes": [own.tobytes()],
                                "codes": [codes.astype(_width(len(own))).tobytes()]})

    for part in parts:
        for lang, text in zip(part["lang"], part["text"]):
            waiting.setdefault(lang, []).append(text)
            length[lang] = length.get(lang, 0) + len(text)
            if length[lang] > 6 * CHUNK_WORDS:
                yield from flush(lang)
            elif sum(length.values()) > 24 * CHUNK_WORDS:
                yield from flush(max(length, key=length.get))
    for lang in list(waiting):
        yield from flush(lang)


def encoded_words(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, n, words, hashes, codes`` of all texts, written once."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"),
                        F.col(text_col).cast("string").alias("text")).where("text <> ''")
    return keep(texts.mapInPandas(_encoded, "lang string, n long, words binary, hashes binary, codes binary"))


def _shards(parts: Iterator[pd.DataFrame], shard_words: int) -> Iterator[tuple[str, list[tuple]]]:
    """``lang`` and chunks of one language, of some ``shard_words`` words. What
    waits is no more than that over all languages; the longest goes first."""
    waiting: dict[str, list[tuple]] = {}
    n: dict[str, int] = {}
    for part in parts:
        for lang, own, *chunk in part.itertuples(index=False, name=None):
            waiting.setdefault(lang, []).append(chunk)
            n[lang] = n.get(lang, 0) + own
            while sum(n.values()) >= shard_words:
                longest = max(n, key=n.get)
                del n[longest]
                yield longest, waiting.pop(longest)
    yield from waiting.items()


def _shard(chunks: list[tuple]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """``words, hashes, codes`` of a shard: one numbering for its chunks."""
    number, codes, own = _Codes({b".": BREAK}), [], []
    for words, hashes, places in chunks:
        to = np.fromiter(map(number.__getitem__, [b".", *words.split(b" ")]), np.int32)
        h, at = _read(hashes, places)
        own.append((to, h))
        codes += [to[at], np.array([BREAK], np.int32)]
    hashes = np.empty(len(number), np.uint64)
    for to, h in own:
        hashes[to] = h
    return [w.decode() for w in number], hashes, np.concatenate(codes)


def _longer(h: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of phrases that go on with a word, from theirs (overwritten) and the word's."""
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h += last
    return h


def _known(h: np.ndarray, union: np.ndarray) -> np.ndarray:
    bit = h >> np.uint64(64 - UNION_BITS)
    return (union[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


def phrases(codes: np.ndarray, hashes: np.ndarray, least: int, union: np.ndarray | None = None):
    """Yield ``k, places, counts, hashes`` of the phrases of each length k that
    occur ``least`` times or more: a place, the exact count and a hash of each.

    A phrase is looked at only if the phrases without its last and without its
    first word were yielded. With ``union`` (a bitmap) it must have its bit
    there; as the bitmap is the same in all shards, so is what is counted.
    """
    here = codes != BREAK  # places where a phrase of the last length starts
    ident, h = codes.copy(), hashes[codes]
    for k in range(1, MAX_WORDS + 1):
        if k == 1:
            at = np.flatnonzero(here).astype(np.int32)
            key = ident[at].astype(np.int64)
        else:
            at = np.flatnonzero(here[:-1] & here[1:]).astype(np.int32)
            last = codes[at + k - 1]
            key = ident[at].astype(np.int64) * len(hashes) + last
            h[at] = _longer(h[at], hashes[last])
            del last
        if union is not None:
            known = _known(h[at], union)
            at, key = at[known], key[known]
            del known
        order = np.argsort(key)
        at, key = at[order], key[order]
        del order
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        counts = np.diff(np.append(starts, len(key))).astype(np.int64)
        often = counts >= least
        of = np.repeat(np.where(often, np.cumsum(often) - 1, -1).astype(np.int32), counts)
        del key
        here = np.zeros(len(codes), bool)
        here[at[of >= 0]] = True
        ident[at] = of
        places = at[starts[often]]
        yield k, places, counts[often], h[places]


def _hashes_of(words: np.ndarray, k: int, union: np.ndarray | None) -> np.ndarray:
    """Hashes of all phrases of ``k`` words whose first and last k - 1 words
    have their bit in ``union``, place by place, from those of the words."""
    here = words != 0  # places where a phrase of the last length starts
    h = words.copy()
    for size in range(1, k + 1):
        if size > 1:
            known = np.zeros(len(here), bool)
            at = np.flatnonzero(here)
            known[at[_known(h[at], union)]] = True
            here = known
            here[:-1] &= here[1:]
            here[-1:] = False
            at = np.flatnonzero(here)
            h[at] = _longer(h[at], words[at + size - 1])
    return h[here]


def _counts(key: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and how often each occurs or the sum of its ``own``."""
    if own is None:
        key = np.sort(key)
    else:
        order = np.argsort(key)
        key, own = key[order], own[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[starts], np.diff(np.append(starts, len(key))) if own is None else np.add.reduceat(own, starts, dtype=np.int64)


def _frequent_slots(chunks: DataFrame, k: int, union: Broadcast | None, min_count: int, shard_words: int, bits: int) -> np.ndarray:
    """The bitmap of the phrases of ``k`` words whose hash occurs ``min_count``
    times or more. Of a hash, the first ``bits`` say the part and the next 32
    are sent; of a count no more than ``min_count``, which decides the same."""
    small = np.min_scalar_type(min_count)

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = None if union is None else union.value
        for _, own in _shards(parts, shard_words):
            rows = []
            for chunk in own:
                hashes, codes = _read(*chunk)
                rows += [hashes[codes], np.zeros(1, np.uint64)]
            h = _hashes_of(np.concatenate(rows), k, known)
            if not len(h):
                continue
            h, n = _counts(h >> np.uint64(32 - bits))
            n = np.minimum(n, min_count).astype(small)
            part = (h >> np.uint64(32)).astype(np.int64)
            h = h.astype(np.uint32)
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            ends = np.append(starts[1:], len(part))
            yield pd.DataFrame({"part": part[starts], "hashes": [h[a:b].tobytes() for a, b in zip(starts, ends)],
                                "n": [n[a:b].tobytes() for a, b in zip(starts, ends)]})

    def add(key, g: pd.DataFrame) -> pd.DataFrame:
        h, n = _counts(np.frombuffer(b"".join(g["hashes"]), np.uint32), np.frombuffer(b"".join(g["n"]), small))
        out = np.zeros(1 << (UNION_BITS - bits), np.uint8)
        out[h[n >= min_count] >> np.uint32(32 - UNION_BITS + bits)] = 1
        return pd.DataFrame({"part": [key[0]], "bits": [np.packbits(out, bitorder="little").tobytes()]})

    found = np.zeros(1 << (UNION_BITS - 3), np.uint8)
    size = len(found) >> bits
    counted = chunks.select("lang", "n", "hashes", "codes").mapInPandas(count, "part long, hashes binary, n binary")
    for r in counted.groupBy("part").applyInPandas(add, "part long, bits binary").collect():
        found[r["part"] * size:(r["part"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return found


def _part_bits(words: int) -> int:
    """Bits of a hash that say its part, for so many words."""
    return min(UNION_BITS - 3, (max(SHARDS, -(-words // PART_PHRASES), 2) - 1).bit_length())


def candidates(chunks: DataFrame, words: int, min_count: int = MIN_COUNT, shard_words: int = SHARD_WORDS) -> np.ndarray:
    """The bitmap of all phrases that may occur ``min_count`` times or more
    among so many ``words``."""
    bits = _part_bits(words)
    union = np.zeros(1 << (UNION_BITS - 3), np.uint8)
    shared = None
    for k in range(1, MAX_WORDS + 1):
        found = _frequent_slots(chunks, k, shared, min_count, shard_words, bits)
        if shared is not None:
            shared.destroy()
        free_shuffles(chunks.sparkSession)
        if not found.any():
            break  # nor is any longer phrase
        union |= found
        shared = chunks.sparkSession.sparkContext.broadcast(union)
    return union


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, lang_col: str = "lang", text_col: str = "text",
                  shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """``(lang, n)`` and ``(lang, phrase, f)`` of all phrases of one to five
    words that occur ``min_count`` times or more in their language."""
    chunks = encoded_words(docs, lang_col, text_col)
    totals = keep(chunks.groupBy("lang").agg(F.sum("n").alias("n")))
    words = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    spark = docs.sparkSession
    union = spark.sparkContext.broadcast(candidates(chunks, words, min_count, shard_words))
    bits = _part_bits(words)
    shift = np.uint64(64 - bits)

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lang, own in _shards(parts, shard_words):
            names, hashes, codes = _shard(own)
            for k, places, counts, h in phrases(codes, hashes, 1, union.value):
                part = h >> shift
                order = np.argsort(part, kind="stable")
                rows = []
                for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else ():
                    # no word holds a line end
                    said = "\n".join([" ".join([names[c] for c in window]) for window in codes[places[at, None] + np.arange(k)].tolist()])
                    rows.append((lang, int(part[at[0]]), zlib.compress(said.encode(), 1), counts[at].tobytes()))
                yield pd.DataFrame(rows, columns=["lang", "part", "phrases", "counts"])

    def add(key, g: pd.DataFrame) -> pd.DataFrame:
        f: dict[str, int] = {}
        for said, counts in zip(g["phrases"], g["counts"]):
            for phrase, n in zip(zlib.decompress(said).decode().split("\n"), np.frombuffer(counts, np.int64).tolist()):
                f[phrase] = f.get(phrase, 0) + n
        f = {phrase: n for phrase, n in f.items() if n >= min_count}
        return pd.DataFrame({"lang": key[0], "phrase": np.array(list(f), object), "f": np.array(list(f.values()), np.int64)})

    counted = chunks.select("lang", "n", "words", "hashes", "codes").mapInPandas(count, "lang string, part long, phrases binary, counts binary")
    return totals, keep(counted.groupBy("lang", "part").applyInPandas(add, "lang string, phrase string, f long"), release=True)


def _part(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, lang_col: str = "lang", text_col: str = "text",
                 shard_words: int = SHARD_WORDS) -> DataFrame:
    """The first ``top`` collocations of each language: ``lang, rank, phrase,
    a, l, r, n, score``.

    Words are lower-cased in A to Z and never cross what ends a piece. Of the
    phrases of two to five words with ``a >= min_count`` occurrences, the cut
    with the lowest ``score = floor(1000 a n / (l r))`` counts (ties: the
    shortest first part); a phrase that lies in a longer one with as many
    occurrences is dropped. Order: score and a descending, phrase ascending in
    bytes. The quotient is taken of 38-digit integers.

    NULL and empty texts have no words, a NULL language is ``und``, repeated
    rows count again, and an empty table gives no rows. Other columns,
    whatever their names, are not read.
    """
    totals, frequent = phrase_counts(docs, min_count, lang_col, text_col, shard_words)
    words = F.split("phrase", " ")
    rows = frequent.withColumn("words", words).withColumn("k", F.size("words"))
    long = rows.where("k > 1")
    one = F.lit(1)
    cuts = long.select("lang", "phrase", F.col("f").alias("a"), "words", "k", F.explode(F.sequence(one, F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _part(F.col("words"), one, F.col("cut")).alias("left"),
                       _part(F.col("words"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    of = lambda name, f: frequent.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    # the parts of a frequent phrase are frequent
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"]).join(totals, "lang")
    score = F.expr("(cast(a as decimal(19,0)) * cast(n as decimal(19,0)) * 1000) div "
                   "(cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    lowest = (cuts.withColumn("score", score).groupBy("lang", "phrase")
              .agg(F.min(F.struct("score", "cut", "l", "r", "a", "n")).alias("m")).select("lang", "phrase", "m.*"))
    # pieces of two words or more inside longer phrases, with the highest count of those
    inner = long.where("k > 2").select("lang", "f", "words", "k", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
    inner = inner.select("lang", "f", "words", "size", F.explode(F.sequence(one, F.col("k") - F.col("size") + 1)).alias("at"))
    inner = (inner.select("lang", "f", _part(F.col("words"), F.col("at"), F.col("size")).alias("phrase"))
             .groupBy("lang", "phrase").agg(F.max("f").alias("inside")))
    left = lowest.join(inner, ["lang", "phrase"], "left").where("inside is null or inside < a")
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (left.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
