"""Secret scan with a random forest against false positives.

Candidates are long runs of key characters, and values of any length and
characters that an announcing word assigns. Labelled findings train a forest,
in numpy, on their length, character transitions, dictionary coverage, path
and neighbouring words; it decides which candidates are secrets.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

CANDIDATE = re.compile(r"[A-Za-z0-9+/_\-]{16,}={0,2}")
LONG_WORD = 20  # letters alone are a candidate from this length on
CONTEXT = 40
# labelled findings of each class that the forest is fitted on, at most
MAX_PER_CLASS = 8_000
TREES, LEAF, LEVELS, CUTS = 40, 4, 9, 24
THRESHOLD = 0.5
# fixed values: words that announce a secret, and the format of one provider
ANNOUNCE = re.compile(r"(?i)(pass(?:word|wd)?|secret|token|api[_-]?key|auth|credential|private)")
# the value, quoted or up to a blank, that an announcing word gets by = or :
ANNOUNCED = re.compile(r"(?i)(?:pass(?:word|wd)?|secret|token|api[_-]?key|auth(?!ors?\b)|credential|private)[\w\-]{0,40}[\"']?"
                       r"[ \t]{0,8}(?::=|=>|[=:])[ \t]{0,8}(?:\"(?P<double>[^\"\n]+)\"|'(?P<single>[^'\n]+)'|[\"']?(?P<bare>[^\s\"']\S*))")
PROVIDER = re.compile(r"AKIA[0-9A-Z]{16}")

_CLASSES = np.zeros(256, dtype=np.int64)
_CLASSES[[*range(48, 58)]] = 1
_CLASSES[[*range(65, 91)]] = 2
_CLASSES[[*range(97, 123)]] = 3


def candidates(text: str | None) -> list[tuple[int, str, str, str]]:
    """Start, value and the text before and after of each candidate."""
    text = text or ""
    spans = set()
    for m in CANDIDATE.finditer(text):
        value = m.group()
        if any(c.isdigit() for c in value) or len(value) >= LONG_WORD:
            spans.add(m.span())
    at = 0
    while m := ANNOUNCED.search(text, at):
        lo, hi = m.span(m.lastgroup)
        at = lo  # a value may hold a further announcement
        if m.lastgroup == "bare":  # separators after a bare value are none of it
            hi = lo + len(m.group("bare").rstrip(",;\"'"))
        if hi > lo:
            spans.add((lo, hi))
    return [(lo, text[lo:hi], text[max(0, lo - CONTEXT):lo], text[hi:hi + CONTEXT]) for lo, hi in sorted(spans)]


def grams(word: str) -> list[str]:
    low = word.lower()
    return [low[i:i + 3] for i in range(len(low) - 2)]


def features(value: str, before: str, after: str, dictionary: dict[str, float]) -> list[float]:
    raw = np.frombuffer(value.encode("latin-1", "replace"), dtype=np.uint8)
    kinds = _CLASSES[raw]
    share = np.bincount(kinds, minlength=4) / len(raw)
    turns = float((kinds[1:] != kinds[:-1]).mean()) if len(raw) > 1 else 0.0
    counts = np.array(list(Counter(value).values())) / len(value)
    entropy = float(-(counts * np.log2(counts)).sum())
    g = grams(value)
    known = [dictionary.get(x, 0.0) for x in g]
    cover = sum(x > 0 for x in known) / max(1, len(g))
    commonness = sum(known) / max(1, len(g))
    words = before.split()[-3:]
    near = [ANNOUNCE.search(w) is not None for w in words]
    last = before[-1:]
    return [len(value), *share.tolist(), turns, entropy, cover, commonness,
            float("/" in value), float(last in "/\\."), float(after[:1] in "/\\"), float(value.count("-") + value.count("_")),
            float(any(near)), float("=" in before[-4:]), float(":" in before[-4:]), float(last in "\"'"), float(len(words)),
            float(after[:1].isalnum()), float(last.isalnum() or last in "+(")]


def label(value: str, before: str) -> int | None:
    """Findings with a known answer: a provider's format or an announced value
    is a secret; a word of letters in one case or a bare number is none."""
    if PROVIDER.fullmatch(value):
        return 1
    if any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and re.search(r"[=:]\s*[\"']?$", before) and ANNOUNCE.search(before[-30:]):
        return 1
    if value.isdigit() or (value.isalpha() and (value.islower() or value[1:].islower() or (value.isupper() and len(set(value)) < 12))):
        return 0
    return None


@dataclass
class Forest:
    """Trees as arrays: feature (-1 in leaves), cut, left child; the right
    child follows the left."""

    feature: list[np.ndarray]
    cut: list[np.ndarray]
    left: list[np.ndarray]
    value: list[np.ndarray]

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, left, value in zip(self.feature, self.cut, self.left, self.value):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(LEVELS + 1):
                f = feature[at]
                inner = f >= 0
                at = np.where(inner, left[at] + (x[rows, np.maximum(f, 0)] > cut[at]), at)
            total += value[at]
        return total / max(1, len(self.feature))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = 11) -> Forest:
    """Bagged trees on random feature subsets, cuts at quantiles, by Gini."""
    rng = np.random.default_rng(seed)
    per = max(1, int(math.sqrt(x.shape[1])) + 1)
    forest = Forest([], [], [], [])
    for _ in range(trees):
        bag = rng.integers(0, len(x), len(x))
        feature, cut, left, value = [-1], [0.0], [0], [float(y[bag].mean())]
        todo = [(0, bag, 0)]
        while todo:
            node, rows, level = todo.pop()
            value[node] = float(y[rows].mean())
            if level >= LEVELS or len(rows) < 2 * LEAF or value[node] in (0.0, 1.0):
                continue
            best = (value[node] * (1 - value[node]) * len(rows) - 1e-9, None, None)
            for f in rng.permutation(x.shape[1])[:per]:
                col = x[rows, f]
                for c in np.unique(np.quantile(col, np.linspace(0, 1, CUTS + 2)[1:-1])):
                    high = col > c
                    n = int(high.sum())
                    if n < LEAF or len(rows) - n < LEAF:
                        continue
                    a, b = y[rows][high].mean(), y[rows][~high].mean()
                    gini = a * (1 - a) * n + b * (1 - b) * (len(rows) - n)
                    if gini < best[0]:
                        best = (gini, f, c)
            if best[1] is None:
                continue
            high = x[rows, best[1]] > best[2]
            feature[node], cut[node], left[node] = int(best[1]), float(best[2]), len(feature)
            for part in (rows[~high], rows[high]):
                todo.append((len(feature), part, level + 1))
                feature.append(-1), cut.append(0.0), left.append(0), value.append(0.0)
        for store, got in ((forest.feature, feature), (forest.cut, cut), (forest.left, left), (forest.value, value)):
            store.append(np.array(got))
    return forest


def find_candidates(docs: DataFrame) -> DataFrame:
    """Every candidate of ``docs(doc_id, text, ...)``: ``doc_id, start, value,
    before, after, label`` (NULL: unknown)."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, s, v, b, a, label(v, b)) for i, t in zip(batch["doc_id"].tolist(), batch["text"].tolist())
                    for s, v, b, a in candidates(t)]
            out = pd.DataFrame(rows, columns=["doc_id", "start", "value", "before", "after", "label"])
            yield out.astype({"label": "Int32", "start": "int64"})

    slim = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = slim.mapInPandas(scan, "doc_id string, start long, value string, before string, after string, label int")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def train(findings: DataFrame, dictionary: dict[str, float], per_class: int = MAX_PER_CLASS) -> Forest | None:
    """Fit on at most ``per_class`` labelled findings of each class, chosen by
    hash of the value; None when a class is missing."""
    known = findings.where("label IS NOT NULL").groupBy("value").agg(
        F.max("label").alias("label"), F.min(F.struct("before", "after")).alias("c"))
    order = [F.xxhash64("value"), F.col("value")]
    sample = (known.where("label = 1").orderBy(*order).limit(per_class)
              .unionByName(known.where("label = 0").orderBy(*order).limit(per_class))).toPandas()  # at most 2 * per_class
    if sample["label"].nunique() < 2:
        return None
    sample = sample.sort_values("value")
    x = np.array([features(v, c["before"], c["after"], dictionary) for v, c in zip(sample["value"], sample["c"])])
    return fit_forest(x, sample["label"].to_numpy(dtype=float))


def dictionary_of(docs: DataFrame, size: int = 4000) -> dict[str, float]:
    """The commonest letter triples of the words of all texts, with log
    frequency scaled to 0 to 1; at most ``size`` entries."""
    word = F.explode(F.split(F.lower(F.col("text").cast("string")), "[^a-z]+")).alias("w")
    words = docs.select(word).where("length(w) BETWEEN 3 AND 12").groupBy("w").agg(F.count("*").alias("n"))
    triple = F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 2), lambda i: F.substr("w", i, F.lit(3)))).alias("g")
    top = (words.select("n", triple).groupBy("g").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "g").limit(size).collect())
    most = math.log(top[0]["n"] + 1) if top else 1.0
    return {r["g"]: math.log(r["n"] + 1) / most for r in top}


def scan_secrets(docs: DataFrame, threshold: float = THRESHOLD, findings: DataFrame | None = None) -> DataFrame:
    """Candidates of ``docs(doc_id, text, ...)`` with the forest's verdict:
    ``doc_id, start, length, value_sha256, score, is_secret``; one row per
    candidate, so repeated rows repeat theirs. NULL and empty texts hold none.
    ``findings(value, before, after, label)`` train the forest; without them,
    the candidates whose answer is known by rule do. Without findings of both
    classes every candidate scores 1."""
    found = keep(find_candidates(docs))
    dictionary = dictionary_of(docs)
    forest = train(found if findings is None else findings, dictionary)
    sent = docs.sparkSession.sparkContext.broadcast((forest, dictionary))

    @F.pandas_udf("double")
    def score(value: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
        model, known = sent.value
        if model is None or not len(value):
            return pd.Series(np.ones(len(value)))
        return pd.Series(model.predict(np.array([features(*row, known) for row in zip(value, before, after)])))

    scored = found.withColumn("score", score("value", "before", "after"))
    return scored.select("doc_id", "start", F.length("value").cast("long").alias("length"), F.sha2("value", 256).alias("value_sha256"),
                         "score", (F.col("score") >= threshold).alias("is_secret"))
