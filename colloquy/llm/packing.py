"""Best-fit packing by exact-complement hashing.

Documents become token pieces of at most ``max_len`` tokens; the pieces are
packed into sequences of ``max_len``. The plan is made on the histogram of
piece lengths, which has ``max_len`` rows however large the corpus is; the
pieces themselves never leave the executors. They are numbered within their
length and look their place up in the plan.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import emptied, keep

MAX_LEN = 2048
END_ID = 0
# entries of a worker's word cache; beyond that it starts anew (speed only)
CACHE_WORDS = 600_000

# Chunks of these characters are in composed form, lower-case letter by
# letter and hold no contraction or special token, so the BPE model can be
# applied to their letter runs, digits and symbol runs directly.
_PLAIN = re.compile(r"[!-&(-;=-~À-ÖØ-öø-ÿ]+")
_RUNS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^0-9A-Za-zÀ-ÖØ-öø-ÿ]+")
_ODD_BLANKS = ("\x1c", "\x1d", "\x1e", "\x1f")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's alphabet: printable bytes stand for themselves, the
    others for the code points from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder(dict):
    """Token ids of words and texts as little-endian uint32 bytes.

    The tokenizer drops white space and never joins across it, so a text's
    ids are those of its blank-separated words, which repeat and are kept.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.runs: dict[str, bytes] = {}

    def _run(self, run: str) -> bytes:
        got = self.runs.get(run)
        if got is None:
            low = run.lower()
            if not low.isascii():
                low = low.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.tokenizer.model.tokenize(low)]
            got = self.runs[run] = struct.pack(f"<{len(ids)}I", *ids)
        return got

    def __missing__(self, word: str) -> bytes:
        if len(self) > CACHE_WORDS:
            self.clear()
        if len(self.runs) > CACHE_WORDS:
            self.runs.clear()
        if _PLAIN.fullmatch(word):
            got = b"".join(map(self._run, _RUNS.findall(word)))
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            got = struct.pack(f"<{len(ids)}I", *ids)
        self[word] = got
        return got

    def text(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(c in text for c in _ODD_BLANKS):  # str.split breaks there, the tokenizer does not
            words = re.findall(r"[^ \t\n\r\x0b\x0c]+", text)
        else:
            words = text.split()
        return b"".join(map(self.__getitem__, words))


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class _Ranks:
    """Numbers pieces within their length, in the order they come in a task."""

    def __init__(self, max_len: int):
        self.seen = np.zeros(max_len + 1, dtype=np.int64)

    def of(self, lengths: pd.Series) -> pd.Series:
        at = lengths.to_numpy(dtype=np.int64)
        out = lengths.groupby(at).cumcount().astype("int64") + self.seen[at]
        self.seen += np.bincount(at, minlength=len(self.seen))
        return out


def token_pieces(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN) -> DataFrame:
    """Pieces ``(doc_id, piece, start, length, ids_crc32)`` of each document's
    ids plus the end id. A NULL or empty text is the end id alone."""
    return _ranked_pieces(docs, tokenizer_path, max_len).drop("_rank")


def _ranked_pieces(docs: DataFrame, tokenizer_path: str, max_len: int) -> DataFrame:
    """``token_pieces`` and ``_rank``, a piece's number within its task and
    length. Numbered where the pieces are made: a function of its own would
    keep a second Python worker, with its own word cache, for every core."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(tokenizer_path)
        ranks = _Ranks(max_len)
        end = struct.pack("<I", END_ID)
        step = 4 * max_len
        with emptied(encoder, encoder.runs):
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
                    ids = encoder.text(text) + end
                    for piece, at in enumerate(range(0, len(ids), step)):
                        part = ids[at:at + step]
                        rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "object"})
                out["_rank"] = ranks.of(out["length"])
                yield out

    # ids travel as text: a NULL id would turn a batch of integers into floats
    slim = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = slim.mapInPandas(run, "doc_id string, piece int, start long, length long, ids_crc32 long, _rank long")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


Groups = list[tuple[int, list[tuple[int, int]]]]


def plan_sequences(counts: np.ndarray) -> Groups:
    """Sequences for ``counts[l]`` pieces of length ``l`` (1 .. capacity).

    Returns groups ``(sequences, [(length, copies), ...])``. From the longest
    length down, the gap it leaves is looked up among single lengths, then
    sums of two, then sums of three, taking as many copies at once as all
    parts have left. What fits nothing exactly goes best-fit, longest first.
    Where the residuals would take more sequences than best-fit needs for
    everything, the last combinations, those of the shortest lengths, are
    undone until they don't: as few of them as doubling and bisection find.
    """
    rest = counts.astype(np.int64).copy()
    rest[0] = 0
    goal = _sequences(_best_fit(rest))
    exact = _exact_complements(rest)

    def without_last(n: int) -> Groups:
        residual = rest.copy()
        for times, parts in exact[len(exact) - n:]:
            for length, copies in parts:
                residual[length] += times * copies
        return exact[:len(exact) - n] + _best_fit(residual)

    low, undone, plan = 0, 0, without_last(0)
    while _sequences(plan) > goal:  # with all of them undone it is the goal
        low, undone = undone, min(len(exact), max(1, 2 * undone))
        plan = without_last(undone)
    while undone - low > 1:
        middle = (low + undone) // 2
        trial = without_last(middle)
        if _sequences(trial) > goal:
            low = middle
        else:
            undone, plan = middle, trial
    return plan


def _sequences(groups: Groups) -> int:
    return sum(times for times, _ in groups)


def _exact_complements(left: np.ndarray) -> Groups:
    """Groups that fill their sequences to the last token; ``left`` is what
    they leave."""
    cap = len(left) - 1
    groups: Groups = []

    def consume(parts: tuple[int, ...]) -> None:
        need = {p: parts.count(p) for p in parts}
        times = min(int(left[p]) // k for p, k in need.items())
        if times:
            for p, k in need.items():
                left[p] -= times * k
            groups.append((times, sorted(need.items(), reverse=True)))

    for top in range(cap, 0, -1):
        if not left[top]:
            continue
        gap = cap - top
        if gap == 0:
            consume((top,))
            continue
        if gap <= top and left[gap]:
            consume((top, gap))
        if left[top]:
            low = np.arange(max(1, gap - top), gap // 2 + 1)
            for b in low[(left[low] > 0) & (left[gap - low] > 0)].tolist():
                if not left[top]:
                    break
                consume((top, gap - b, b))
        if left[top]:
            for a in range(min(top, gap - 2), max(0, -(-gap // 3) - 1), -1):
                if not left[top]:
                    break
                if not left[a]:
                    continue
                rest = gap - a
                low = np.arange(max(1, rest - a), rest // 2 + 1)
                for b in low[(left[low] > 0) & (left[rest - low] > 0)].tolist():
                    if not left[top] or not left[a]:
                        break
                    consume((top, a, rest - b, b))
    return groups


def _best_fit(left: np.ndarray) -> Groups:
    """Best-fit, longest first, on counts: equal sequences are one group."""
    cap = len(left) - 1
    open_by_gap: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}

    def add(parts: list[tuple[int, int]], length: int, copies: int) -> list[tuple[int, int]]:
        if parts and parts[-1][0] == length:
            return [*parts[:-1], (length, parts[-1][1] + copies)]
        return [*parts, (length, copies)]

    for length in range(cap, 0, -1):
        n = int(left[length])
        while n:
            gap = min((g for g in open_by_gap if g >= length), default=None)
            if gap is None:
                per = cap // length
                times, copies = (n // per, per) if n >= per else (1, n)
                open_by_gap.setdefault(cap - copies * length, []).append((times, [(length, copies)]))
                n -= times * copies
                continue
            times, parts = open_by_gap[gap].pop()
            copies = min(gap // length, n)
            used = min(times, n // copies)
            if used < times:
                open_by_gap[gap].append((times - used, parts))
            elif not open_by_gap[gap]:
                del open_by_gap[gap]
            open_by_gap.setdefault(gap - length * copies, []).append((used, add(parts, length, copies)))
            n -= used * copies
    return [group for same in open_by_gap.values() for group in same]


def _places(groups: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Plan rows ``length, first ordinal, copies per sequence, first sequence,
    offset`` sorted by length and ordinal."""
    rows, nxt, sequence = [], {}, 0
    for times, parts in groups:
        offset = 0
        for length, copies in parts:
            first = nxt.get(length, 0)
            nxt[length] = first + times * copies
            rows.append((length, first, copies, sequence, offset))
            offset += length * copies
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """Add ``sequence_id, offset`` to pieces with a ``length`` of 1 to
    ``max_len``. An empty input gives no rows; repeated rows each get a place
    of their own; which of two equal rows gets which place is not fixed."""
    def ranks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from map(_Ranks(max_len).of, batches)

    rank = F.pandas_udf("long")(ranks).asNondeterministic()
    return _placed(pieces.withColumn("_rank", rank(F.col("length").cast("long"))), max_len)


def _placed(ranked: DataFrame, max_len: int) -> DataFrame:
    """``pack`` for pieces with their ``_rank`` within task and length."""
    spark = ranked.sparkSession
    # the written table fixes the numbers, whichever attempt of a task wrote them
    placed = keep(ranked.withColumn("_task", F.spark_partition_id()))
    by_task = placed.groupBy("length", "_task").agg(F.count("*").alias("n"))
    # a row for each task and length
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_task.select("length", "_task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    counts = np.zeros(max_len + 1, dtype=np.int64)
    for row in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most max_len rows
        counts[row["length"]] = row["n"]
    places = spark.sparkContext.broadcast(_places(plan_sequences(counts)))
    # a key has at most the rows of one task
    numbered = (placed.join(keep(starts), ["length", "_task"])
                .withColumn("_ordinal", (F.col("_first") + F.col("_rank")).cast("long")))

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length: pd.Series, ordinal: pd.Series) -> pd.DataFrame:
        plan = places.value
        at = np.searchsorted(plan[:, 0] * (1 << 44) + plan[:, 1],
                             length.to_numpy() * (1 << 44) + ordinal.to_numpy(), side="right") - 1
        row = plan[at]
        k = ordinal.to_numpy() - row[:, 1]
        return pd.DataFrame({"sequence_id": row[:, 3] + k // row[:, 2],
                             "offset": row[:, 4] + (k % row[:, 2]) * row[:, 0]})

    return (numbered.withColumn("_place", place(F.col("length").cast("long"), F.col("_ordinal")))
            .select(*[F.col(c) for c in ranked.columns if c != "_rank"], "_place.sequence_id", "_place.offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, max_len: int = MAX_LEN) -> DataFrame:
    """Pack ``docs(doc_id, text, ...)`` into as few sequences as the plan
    finds; one row per piece: ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset``. Only documents of more than ``max_len`` ids are
    cut. Other columns of the input are not carried."""
    return _placed(_ranked_pieces(docs, tokenizer_path, max_len), max_len)
