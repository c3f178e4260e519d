"""Masked pseudo-likelihood scoring.

A network trained in numpy predicts every word from a window on both sides
of it; a document's score is the sum of the log-probabilities of its words.
The vocabulary comes from counts over the whole corpus. A word's class is
told by a binary tree, a step per bit, so a word costs as many products as
the tree is deep instead of one per class. A word that shares its class with
others also has its probability within the class, from its count over the
whole corpus, with a share kept for words never counted.

A text's words are looked up once and their classes written, which training
and scoring read. Training takes the window of every word of every text. The
classes of the texts are dealt evenly over trainers whose number follows the
corpus; each trains a copy on its share and the copies are averaged, row by
row, by Spark.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep

FREQUENT = 384  # commonest words, each a class of its own
OTHER = 127  # classes for the other words, by hash
UNKNOWN = 0.5  # count that each of these classes keeps for words never counted
CLASSES = FREQUENT + OTHER + 1  # and one for the places outside a text
OUTSIDE = CLASSES - 1
DEPTH = (CLASSES - 1).bit_length()  # steps of the tree
SIDE = 2  # words seen on either side
WIDTH = 24
ROUNDS = 2  # each learns its share of the words, together all of them
BATCH = 512
AT_ONCE = 1024  # words scored together, so their rows stay in the processor's cache
RATE = 0.15
BLOCK = 4096  # targets in a row of the training table
TRAINER_BLOCKS = 256  # rows of that table per trainer, about
SEEN = 1 << 15  # marks words of a row that are no targets of it
CACHE_WORDS = 400_000
KNOWN = 65_536  # commonest words whose count every worker has; the others' are joined


class _Classes(dict):
    def __init__(self, frequent: list[str]):
        super().__init__()
        self.frequent = {w: i for i, w in enumerate(frequent)}

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        got = self.frequent.get(word)
        if got is None:
            got = FREQUENT + zlib.crc32(word.encode("utf-8", "surrogatepass")) % OTHER
        self[word] = got
        return got

    def __reduce__(self):
        return _Classes, (list(self.frequent),)

    def of(self, text: str | None) -> np.ndarray:
        return np.array(list(map(self.__getitem__, words_of(text))), dtype=np.int64)


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def _tree() -> tuple[np.ndarray, np.ndarray]:
    """Nodes on the way to each class, and the turn (-1 or 1) taken there."""
    step = np.arange(DEPTH)
    code = np.arange(CLASSES)[:, None]
    nodes = (1 << step) - 1 + (code >> (DEPTH - step))
    return nodes, (2 * ((code >> (DEPTH - 1 - step)) & 1) - 1).astype(np.float32)


NODES, TURNS = _tree()
N_NODES = (1 << DEPTH) - 1
# where the rows of a table lie, two numbers (as the parts of a complex one) at a time
_PAIRS = np.arange(2 * SIDE * CLASSES * WIDTH // 2).reshape(-1, WIDTH // 2)
_PLACES = (np.arange(2 * SIDE) * CLASSES)[:, None]
_NEAR = [k + (k >= SIDE) for k in range(2 * SIDE)]  # places of a window around its target


def _add_rows(table: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Add each of ``rows`` to the row of ``table`` at its place; on flat
    places, which numpy adds several times faster than whole rows."""
    pairs = np.ascontiguousarray(rows, table.dtype).reshape(-1).view(np.complex64)
    np.add.at(table.reshape(-1).view(np.complex64), np.take(_PAIRS, at, axis=0).reshape(-1), pairs)


@dataclass
class Network:
    """``near``: an embedding per place and class; ``out`` and ``bias``: of
    the nodes of the tree; ``hidden``: bias of the hidden layer."""

    near: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray

    @staticmethod
    def start(seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        near = rng.normal(0, 0.1, (2 * SIDE, CLASSES, WIDTH)).astype(np.float32)
        out = rng.normal(0, 0.1, (N_NODES, WIDTH)).astype(np.float32)
        return Network(near, out, np.zeros(N_NODES, np.float32), np.zeros(WIDTH, np.float32))

    def forward(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hidden layer, the steps' outputs (turned so that more is likelier)
        and the nodes' rows."""
        h = np.take(self.near[0], window[:, _NEAR[0]], axis=0)
        h += self.hidden
        for k in range(1, 2 * SIDE):
            h += np.take(self.near[k], window[:, _NEAR[k]], axis=0)
        np.tanh(h, out=h)
        target = window[:, SIDE]
        nodes = np.take(NODES, target, axis=0)
        rows = np.take(self.out, nodes, axis=0)
        z = np.matmul(rows, h[:, :, None])[:, :, 0]
        z += np.take(self.bias, nodes)
        z *= np.take(TURNS, target, axis=0)
        return h, z, rows

    def learn(self, window: np.ndarray) -> None:
        h, z, rows = self.forward(window)
        target = window[:, SIDE]
        nodes = np.take(NODES, target, axis=0)
        d = np.take(TURNS, target, axis=0) / (1 + np.exp(np.clip(z, -30, 30)))
        step = RATE / len(target) ** 0.5
        back = np.einsum("nl,nlk->nk", d, rows) * (1 - h * h)
        d *= step
        _add_rows(self.out, nodes, np.einsum("nl,nk->nlk", d, h))
        np.add.at(self.bias, nodes.reshape(-1), d.reshape(-1))
        self.hidden += step * back.sum(axis=0)
        back *= step
        _add_rows(self.near, window.T[_NEAR] + _PLACES, np.broadcast_to(back, (2 * SIDE, *back.shape)))

    def rows(self) -> np.ndarray:
        """All parameters as rows of WIDTH numbers."""
        flat = np.concatenate([self.near.ravel(), self.out.ravel(), self.bias, self.hidden])
        return np.pad(flat, (0, -len(flat) % WIDTH)).reshape(-1, WIDTH)

    @staticmethod
    def of_rows(rows: np.ndarray) -> Network:
        flat = rows.astype(np.float32).ravel()
        sizes = np.cumsum([2 * SIDE * CLASSES * WIDTH, N_NODES * WIDTH, N_NODES, WIDTH])
        near, out, bias, hidden = np.split(flat[:sizes[-1]], sizes[:-1])
        return Network(near.reshape(2 * SIDE, CLASSES, WIDTH), out.reshape(N_NODES, WIDTH), bias, hidden)

    def log_likelihood(self, ids: np.ndarray) -> float:
        total = 0.0
        edge = np.full(SIDE, OUTSIDE)
        wide = np.concatenate([edge, ids, edge])
        for at in range(0, len(ids), AT_ONCE):
            _, z, _ = self.forward(np.lib.stride_tricks.sliding_window_view(wide[at:at + AT_ONCE + 2 * SIDE], 2 * SIDE + 1))
            total -= float(np.log1p(np.exp(-np.clip(z, -30, 30))).sum(dtype=np.float64))
        return total


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, count`` over all texts, written once."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def emptied() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "count"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(words_of(text))
                if len(counts) > CACHE_WORDS:
                    yield emptied()
        yield emptied()

    each = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, count long")
    return keep(each.groupBy("word").agg(F.sum("count").alias("count")))


def vocabulary(counts: DataFrame) -> list[str]:
    """The FREQUENT commonest words."""
    return [r["word"] for r in counts.orderBy(F.desc("count"), "word").limit(FREQUENT).collect()]


class WithinClass:
    """log P(word | class) by the counts: 0 for the vocabulary, whose words
    are classes of their own. The KNOWN commonest words are at hand; the others
    are looked up by a join with the counts."""

    def __init__(self, counts: DataFrame, frequent: list[str]):
        self.counts = counts
        self.own_class = (F.crc32(F.encode("word", "utf-8")) % OTHER).cast("int")
        other = counts.where(~F.col("word").isin(frequent))
        self.totals = dict.fromkeys(range(OTHER), 0) | dict(map(tuple, other.groupBy(self.own_class).agg(F.sum("count")).collect()))
        known = counts.orderBy(F.desc("count"), "word").limit(KNOWN).select("word", self.log_p().alias("p")).collect()
        self.known = dict(map(tuple, known)) | dict.fromkeys(frequent, 0.0)

    def log_p(self) -> Column:
        """From the columns ``word`` and ``count``; words without a count have
        the share kept for them."""
        total = F.get(F.array(*[F.lit(math.log(self.totals[k] + UNKNOWN)) for k in range(OTHER)]), self.own_class)
        return F.log(F.coalesce(F.col("count").cast("double"), F.lit(UNKNOWN))) - total

    def summed(self, words: DataFrame, key: str) -> DataFrame:
        """``key, within``: the sum over the ``word``s of each key."""
        return words.join(self.counts, "word", "left").select(key, self.log_p().alias("p")).groupBy(key).agg(F.sum("p").alias("within"))


def _blocks(texts: Iterable[np.ndarray]) -> Iterator[bytes]:
    """The texts' classes, BLOCK targets at a time."""
    edge = np.full(SIDE, OUTSIDE)
    held: list[np.ndarray] = []
    size = 0
    for classes in texts:
        wide = np.concatenate([edge, classes, edge]).astype(np.uint16)
        at, end = SIDE, len(wide) - SIDE
        while at < end:
            to = min(end, at + BLOCK - size)
            piece = wide[at - SIDE:to + SIDE].copy()
            piece[:SIDE] |= SEEN
            piece[len(piece) - SIDE:] |= SEEN
            held.append(piece)
            size += to - at
            at = to
            if size == BLOCK:
                yield np.concatenate(held).tobytes()
                held, size = [], 0
    if held:
        yield np.concatenate(held).tobytes()


def _dealt(texts: DataFrame, classes_of: Callable[[list], Iterator[np.ndarray]]) -> DataFrame:
    """``stream``: the classes of the texts of the one column, BLOCK targets in
    a row (16-bit numbers), written once to the shared folder and dealt evenly,
    so no trainer gets a long text whole. Every word of every text is a target
    once; words marked SEEN are only there to be seen by their neighbours."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = _blocks(chain.from_iterable(classes_of(batch.iloc[:, 0].tolist()) for batch in batches))
        while some := list(islice(blocks, 64)):
            yield pd.DataFrame({"stream": some})

    rows = keep(texts.mapInPandas(cut, "stream binary"))
    trainers = -(-rows.count() // TRAINER_BLOCKS) or 1
    return keep(rows.repartition(trainers, F.xxhash64("stream")))


def training_windows(docs: DataFrame, sent: Broadcast) -> DataFrame:
    """The training table of all texts of ``docs``, as ``_dealt`` makes it."""
    return _dealt(docs.select(F.col("text").cast("string")), lambda texts: map(_known(sent.value).of, texts))


def _coded_windows(coded: DataFrame) -> DataFrame:
    """The same of texts whose classes are written."""
    return _dealt(coded.select("classes"), lambda texts: (np.frombuffer(b, np.uint16) for b in texts))


def coded(docs: DataFrame, frequent: list[str], known: dict[str, float]) -> DataFrame:
    """``doc_id, n_words, p, others, classes, row``, written once, so that
    texts are taken apart once to be learned and scored: the classes of the
    words (16-bit numbers), the sum of log P(word | class) of the words at hand
    and the other words."""
    sent = docs.sparkSession.sparkContext.broadcast((frequent, known))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _at_hand(*sent.value)
        for batch in batches:
            n_words, sums, classes, others, ends = [], [], [], [], [0]
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                codes = np.fromiter(map(table.__getitem__, words), np.int64, len(words))
                n_words.append(len(words))
                sums.append(float(np.take(table.p, codes).sum()))
                classes.append(np.take(table.classes, codes).tobytes())
                others += map(words.__getitem__, np.flatnonzero(codes >= len(table.known)).tolist())
                ends.append(len(others))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(others, pa.string()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(sums, pa.float64()), lists, pa.array(classes, pa.binary())],
                names=["doc_id", "n_words", "p", "others", "classes"])

    fields = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("p", T.DoubleType()),
                           T.StructField("others", T.ArrayType(T.StringType())), T.StructField("classes", T.BinaryType())])
    return keep(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(encode, fields)
                .withColumn("row", F.monotonically_increasing_id()))


def targets(stream: bytes, turn: int, rounds: int) -> np.ndarray:
    """The windows of a row of the training table that are learned in a round:
    every ``rounds``-th target, so the rounds together take each once. They
    are mixed, so that neighbours aren't learned together."""
    marked = np.frombuffer(stream, np.uint16).astype(np.int64)
    wide = np.lib.stride_tricks.sliding_window_view(marked & ~SEEN, 2 * SIDE + 1)
    own = np.flatnonzero((marked[SIDE:len(marked) - SIDE] & SEEN) == 0)[turn::rounds]
    return wide[np.random.default_rng(turn).permutation(own)]


def train(table: DataFrame, rounds: int = ROUNDS) -> Network:
    """The averaged network from a training table. Every word of every text is
    a target in one of the rounds; a trainer's copy weighs by the targets it saw. The driver receives one
    average per parameter row, whatever the corpus."""
    spark = table.sparkSession
    net = Network.start()
    fields = ", ".join(f"v{k} double" for k in range(WIDTH))
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(net)

        def learn(batches: Iterator[pd.DataFrame], sent=sent, turn=turn) -> Iterator[pd.DataFrame]:
            own = Network.of_rows(sent.value.rows())
            seen = 0
            for batch in batches:
                for block in batch["stream"].tolist():
                    window = targets(block, turn, rounds)
                    for at in range(0, len(window), BATCH):
                        own.learn(window[at:at + BATCH])
                    seen += len(window)
            rows = own.rows()
            out = pd.DataFrame(rows.astype(np.float64), columns=[f"v{k}" for k in range(WIDTH)])
            out.insert(0, "weight", float(seen))
            out.insert(0, "row", np.arange(len(rows)))
            yield out if seen else out.iloc[:0]

        copies = table.mapInPandas(learn, f"row int, weight double, {fields}")
        mean = [(F.sum(F.col(f"v{k}") * F.col("weight")) / F.sum("weight")).alias(f"v{k}") for k in range(WIDTH)]
        averaged = copies.groupBy("row").agg(*mean).orderBy("row").toPandas()  # one row per parameter row
        if not len(averaged):
            break
        net = Network.of_rows(averaged.drop(columns="row").to_numpy())
    return net


def score(docs: DataFrame, rounds: int = ROUNDS, corpus: DataFrame | None = None) -> DataFrame:
    """``doc_id, n_words, log_likelihood, mean_log_likelihood`` per row of
    ``docs(doc_id, text, ...)``. NULL and empty texts have no words, a sum of
    0 and no mean; repeated rows score alike; an empty table gives no rows.
    Network and word counts come from ``corpus``, by default ``docs``."""
    learned = docs if corpus is None else corpus
    counts = word_counts(learned)
    frequent = vocabulary(counts)
    within = WithinClass(counts, frequent)
    texts = coded(docs, frequent, within.known)
    table = _coded_windows(texts) if corpus is None else training_windows(corpus, docs.sparkSession.sparkContext.broadcast(frequent))
    sent = docs.sparkSession.sparkContext.broadcast(train(table, rounds))

    @F.pandas_udf("double")
    def scored(classes: pd.Series) -> pd.Series:
        return pd.Series([sent.value.log_likelihood(np.frombuffer(b, np.uint16)) for b in classes.tolist()], dtype="float64")

    rows = keep(texts.select("doc_id", "n_words", "row", (scored("classes") + F.col("p")).alias("log_likelihood")))
    others = within.summed(texts.select("row", F.explode("others").alias("word")), "row")
    out = rows.join(others, "row", "left").select(
        "doc_id", "n_words", (F.col("log_likelihood") + F.coalesce("within", F.lit(0.0))).alias("log_likelihood"))
    return out.withColumn("mean_log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))


class _AtHand(dict):
    """Places of words in ``classes`` and ``p`` (log P(word | class)): those
    of ``known``, then one for every class of words that are not, whose p is
    looked up elsewhere and 0 here."""

    def __init__(self, frequent: list[str], known: dict[str, float]):
        self.known = {w: i for i, w in enumerate(known)}
        super().__init__(self.known)
        self.classes = np.array([*map(_Classes(frequent).__getitem__, known), *range(FREQUENT, FREQUENT + OTHER)], np.uint16)
        self.p = np.array([*known.values(), *[0.0] * OTHER])

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
            self.update(self.known)
        self[word] = got = len(self.known) + zlib.crc32(word.encode("utf-8", "surrogatepass")) % OTHER
        return got


_TABLES: dict[tuple, dict] = {}


def _kept(kind: type[dict], words: Iterable[str], *of) -> dict:
    """A worker's table of the words, kept between batches and tasks."""
    key = kind, zlib.crc32("\n".join(words).encode("utf-8", "surrogatepass"))
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = kind(*of)
    return _TABLES[key]


def _known(words: list[str]) -> _Classes:
    return _kept(_Classes, words, words)


def _at_hand(frequent: list[str], known: dict[str, float]) -> _AtHand:
    return _kept(_AtHand, known, frequent, known)
