"""Toxicity by maximum-scoring segments.

Each word carries the log-odds of toxic against other text under a Dirichlet
prior, from the documents that hold the word or its stem. A linear scan finds every
maximal-scoring run of words; a run's score is judged against the extreme
value distribution of the best runs of non-toxic documents, which makes
scores of short and long documents comparable. Runs that chance would give
less than ``E_VALUE`` times in a text of that length are its toxic passages.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import emptied, keep

BINS = 1 << 18
STEMS = (4, 6)  # a word also counts under its first letters
PRIOR_TOKENS = 20_000.0  # weight of the Dirichlet prior, in counted words
EVIDENCE = 25.0  # likelihood ratio statistic below which a log-odds counts as zero
DRIFT = 0.1  # cost of a neutral word in a segment
TOP = 6.0
# labelled documents of each class that the model is fitted on, at most
MAX_PER_CLASS = 12_000
THRESHOLD = 0.7
E_VALUE = 0.05  # a passage counts where chance gives fewer of its kind in the text
CACHE_WORDS = 400_000

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def bin_of(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) & (BINS - 1)


def features(word: str) -> tuple[int, ...]:
    """Bins of the word and of its stems."""
    return bin_of("w " + word), *(bin_of(f"{n} {word[:n]}") for n in STEMS)


class WordScores(dict):
    """Scores of words, computed when first asked for."""

    def __init__(self, score: np.ndarray):
        super().__init__()
        self.score = score

    def __missing__(self, word: str) -> float:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = got = float(max((self.score[b] for b in features(word)), key=abs)) - DRIFT
        return got


@dataclass
class ToxicityModel:
    score: np.ndarray  # by bin: confident log-odds
    scale: float = 1.0  # lambda of the extreme value distribution
    size: float = 0.1  # its K
    intercept: float = -4.0
    slope: float = 1.0

    def __post_init__(self):
        self.words = WordScores(self.score)

    def __reduce__(self):
        return ToxicityModel, (self.score, self.scale, self.size, self.intercept, self.slope)

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        words = words_of(text)
        scores = np.array(list(map(self.words.__getitem__, words)), dtype=np.float64)
        seen: dict[str, int] = {}
        for i in np.flatnonzero(scores > 0).tolist():  # a word that repeats tells less each time
            seen[words[i]] = k = seen.get(words[i], 0) + 1
            if k > 1:
                scores[i] = (scores[i] + DRIFT) / (k * k) - DRIFT
        return len(words), maximal_segments(scores)

    def normalised(self, score: float, n: int) -> float:
        """Score in nats above what chance gives in ``n`` words."""
        return self.scale * score - math.log(max(self.size * n, 1e-9))

    def judge(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's evidence and its toxic passages, left to right:
        first word, word after the last, expected number by chance."""
        n, found = self.segments(text)
        marks = [self.normalised(score, n) for _, _, score in found]
        passages = [(lo, hi, math.exp(-mark)) for (lo, hi, _), mark in zip(found, marks) if mark >= SURE]
        return combined(marks), passages

    def probability(self, evidence: float) -> float:
        z = self.intercept + self.slope * evidence
        return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, z))))


SURE = -math.log(E_VALUE)
EMPTY = -10.0  # evidence of a text without a single positive word


def combined(marks: list[float]) -> float:
    """The best run, significant or not, plus what each further significant
    passage adds, discounted by its rank."""
    best, *others = sorted(marks, reverse=True) or [EMPTY]
    extra = sum(m / (k * k) for k, m in enumerate(others, 2) if m >= SURE)
    return max(EMPTY, min(60.0, best + extra))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring runs (first, end, score), left to right, in linear
    time: a new positive word extends back over the latest run that starts
    lower and ends lower than it; links to the next lower start save
    searching again."""
    total = np.concatenate(([0.0], np.cumsum(scores)))
    runs: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum after, link
    for i in np.flatnonzero(scores > 0).tolist():
        first, end, before, after = i, i + 1, float(total[i]), float(total[i + 1])
        while True:
            j = len(runs) - 1
            while j >= 0 and runs[j][2] >= before:
                j = runs[j][4]
            if j < 0 or runs[j][3] >= after:
                runs.append((first, end, before, after, j))
                break
            first, before = runs[j][0], runs[j][2]
            del runs[j:]
    return [(a, b, y - x) for a, b, x, y, _ in runs]


def held_out(doc_id: Column) -> Column:
    """Documents never learned from; without an id there is no label to learn."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def _sample(labels: DataFrame, per_class: int) -> DataFrame:
    """At most ``per_class`` training ids of each class, by hash of the id. A
    document labelled both ways counts as toxic."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    return (known.where("toxic = 1").orderBy(*order).limit(per_class)
            .unionByName(known.where("toxic = 0").orderBy(*order).limit(per_class)))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros((2, BINS), dtype=np.int64)
    bins: dict[str, tuple[int, ...]] = {}
    for batch in batches:
        for text, toxic in zip(batch["text"].tolist(), batch["toxic"].tolist()):
            found: set[int] = set()  # a feature counts once in a document
            for w in set(words_of(text)):
                if w not in bins:
                    if len(bins) > CACHE_WORDS:
                        bins.clear()
                    bins[w] = features(w)
                found.update(bins[w])
            if found:
                counts[int(toxic), list(found)] += 1
    some = np.flatnonzero(counts.any(axis=0))
    yield pd.DataFrame({"bin": some, "other": counts[0, some], "toxic": counts[1, some]})


def log_odds(other: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Log-odds with an informative Dirichlet prior; zero where the likelihood
    ratio test doesn't tell the two rates apart."""
    both = other + toxic
    share = both / max(1.0, both.sum())
    prior = PRIOR_TOKENS * share + 0.01
    logits, ratio = [], np.zeros_like(share)
    for side in (toxic, other):
        n = side.sum() + prior.sum()
        logits.append(np.log(side + prior) - np.log(n - side - prior))
        expected = np.maximum(side.sum() * share, 1e-12)
        ratio += 2 * side * np.log(np.maximum(side, 1e-12) / expected)
    delta = logits[0] - logits[1]
    return np.clip(np.where(ratio >= EVIDENCE, delta, 0.0), -TOP, TOP)


def fit_extremes(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """``lambda, K`` of P(best > x) = 1 - exp(-K n exp(-lambda x)) by moments;
    documents without a positive word tell nothing about the tail."""
    some = (best > 0) & (n > 0)
    if some.sum() < 20:
        return 1.0, 0.1
    x, size = best[some], np.log(n[some])
    lam = 1.0
    for _ in range(50):
        spread = np.std(x - size / lam)
        new = math.pi / math.sqrt(6) / max(spread, 1e-3)
        new = min(5.0, max(0.2, 0.5 * (lam + new)))
        if abs(new - lam) < 1e-6:
            break
        lam = new
    k = math.exp(lam * float(np.mean(x - size / lam)) - 0.5772156649)
    return lam, max(1e-6, k)


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope with a weak ridge, by Newton steps. A quarter of
    the toxic documents say nothing toxic in words the model knows, so the
    slope is kept positive."""
    w = np.array([-2.0, 0.5])
    design = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + 0.05 * (w - np.array([-2.0, 0.5]))
        hess = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + 0.05 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), max(0.05, float(w[1]))


def train(docs: DataFrame, labels: DataFrame, per_class: int = MAX_PER_CLASS) -> ToxicityModel:
    """Fit on at most ``per_class`` labelled documents of each class that are
    not held out. Three quarters of them give the log-odds, one quarter the
    extreme value distribution and the logistic curve. Without labels every
    score is that of neutral text."""
    ids = _sample(labels.select("doc_id", "toxic"), per_class)
    # at most 2 * per_class ids and flags
    sample = keep(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
                  .select("doc_id", "text", "toxic"))
    part = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(4))
    counted = (sample.where(part != 0).select("text", "toxic")
               .mapInPandas(_count, "bin long, other long, toxic long")
               .groupBy("bin").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))).toPandas()
    counts = np.zeros((2, BINS))
    at = counted["bin"].to_numpy(dtype=np.int64)
    counts[0, at], counts[1, at] = counted["other"].to_numpy(), counted["toxic"].to_numpy()
    model = ToxicityModel(log_odds(*counts))
    held = sample.where(part == 0).select("text", "toxic")

    def told(sent: Broadcast, of) -> pd.DataFrame:
        """One row of figures for each calibration document."""
        def figures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            with emptied(sent.value.words):
                for batch in batches:
                    rows = [(toxic, *of(text)) for text, toxic in zip(batch["text"].tolist(), batch["toxic"].tolist())]
                    yield pd.DataFrame(rows, columns=["toxic", "n", "x"])

        return held.mapInPandas(figures, "toxic int, n long, x double").toPandas()

    sent = docs.sparkSession.sparkContext.broadcast(model)

    def best_run(text: str | None) -> tuple[int, float]:
        n, found = sent.value.segments(text)
        return n, max((score for _, _, score in found), default=0.0)

    runs = told(sent, best_run)
    if runs["toxic"].nunique() < 2:
        return model
    clean = runs[runs["toxic"] == 0]
    model.scale, model.size = fit_extremes(clean["x"].to_numpy(), clean["n"].to_numpy(dtype=float))
    fitted = docs.sparkSession.sparkContext.broadcast(model)
    # the very evidence that documents are scored by
    evidence = told(fitted, lambda text: (0, fitted.value.judge(text)[0]))
    model.intercept, model.slope = fit_logistic(evidence["x"].to_numpy(), evidence["toxic"].to_numpy(dtype=float))
    return model


def judged(docs: DataFrame, model: ToxicityModel, text: str = "text") -> Column:
    """Column ``score, first, end, e_value``: the probability that a text is
    toxic and its toxic passages in lists of equal length. NULL and empty
    texts score as neutral text of no words and hold no passage."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, first array<int>, end array<int>, e_value array<double>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with emptied(sent.value.words):
            for texts in batches:
                rows = []
                for t in texts.tolist():
                    evidence, passages = sent.value.judge(t)
                    rows.append((sent.value.probability(evidence), *([p[k] for p in passages] for k in range(3))))
                yield pd.DataFrame(rows, columns=["score", "first", "end", "e_value"])

    return judge(docs[text].cast("string"))


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = MAX_PER_CLASS) -> DataFrame:
    """``docs`` with ``toxicity_score`` and ``toxic_passages`` added (columns
    of these names are replaced): every passage ``first, end, e_value`` of the
    text, counted in words, that chance gives less than ``E_VALUE`` times.
    Texts are scanned whole, whatever their length. Repeated rows each get the
    same result; labels are used to fit only; languages, sources and ids are
    never inputs of a score."""
    model = train(docs, labels, per_class)
    kept = [docs[c] for c in docs.columns if c not in ("toxicity_score", "toxic_passages")]
    return (docs.select(*kept, judged(docs, model).alias("_judged"))
            .withColumn("toxicity_score", F.col("_judged.score"))
            .withColumn("toxic_passages", F.arrays_zip("_judged.first", "_judged.end", "_judged.e_value"))
            .drop("_judged"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that score ``threshold`` or more."""
    model = train(docs, labels)
    return docs.where(judged(docs, model)["score"] < threshold)
