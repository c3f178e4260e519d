"""Quality rules with cross-document line frequency.

Lines are normalised and hashed, distinct documents are counted per host and
line, lines above the limit are removed, and a document that loses more than
half of its words so is rejected. Word, symbol and repetition counts of the
whole text are the base rules. DataFrame code only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key

BLANKS = "[\\x20\\x09-\\x0D]+"
MIN_WORDS = 50
# a line in more documents of one host than this is boilerplate
MAX_DOCS_PER_HOST = 100
# share of its words that a document may lose
MAX_LOSS = 0.5


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def base_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed``.

    Repeated words: the hashes of all three-word windows are sorted with their
    positions, windows equal to a neighbour are the repeated ones, and the
    words they cover are counted, all inside the row.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keep = [F.col(c) for c in docs.columns]
    own = [c for c in docs.columns]
    one = docs.select(*keep, text.alias("_t"), F.transform(_words(text), lambda w: F.xxhash64(w)).alias("_w"),
                      F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("_lines"))
    one = one.select(*own, "_w", F.size("_w").cast("long").alias("n_words"),
                     F.length(F.regexp_replace("_t", BLANKS, "")).cast("long").alias("word_chars"),
                     F.length(F.regexp_replace("_t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                     (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"))
    out = [*own, "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    windows = F.when(F.size("_w") >= 3, F.slice(
        F.transform("_w", lambda h, i: F.xxhash64(h, F.get("_w", i + 1), F.get("_w", i + 2))), F.lit(1), F.size("_w") - 2)
    ).otherwise(F.array().cast("array<bigint>"))
    two = one.select(*out, windows.alias("_v"))
    # most texts repeat no window: a set tells
    some = F.size(F.array_distinct("_v")) < F.size("_v")
    three = two.select(*out, F.when(some, F.sort_array(F.transform("_v", lambda v, i: F.struct(v.alias("v"), i.alias("i"))))).alias("_s"))
    same = lambda e, j: F.coalesce(e["v"] == F.get("_s", j)["v"], F.lit(False))
    four = three.select(*out, F.sort_array(F.transform(
        F.filter("_s", lambda e, j: same(e, j - 1) | same(e, j + 1)), lambda e: e["i"])).alias("_p"))
    covered = F.aggregate(F.transform("_p", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("_p", j + 1), p + 3) - p)),
                          F.lit(0).cast("long"), lambda acc, x: acc + x)
    five = four.select(*out, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))
    return five.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _place(host: str) -> list[Column]:
    """``_no, _host``: the host, a NULL one being a host of its own."""
    return [F.col(host).isNull().alias("_no"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host")]


ROW = ["_uid", "_th", "_no", "_host"]


def _lines(docs: DataFrame, host: str) -> DataFrame:
    """One row per document of a host and distinct line with its words, over
    all the line's places; lines without words are left out. Repeats of a row
    have the same places, so they add nothing."""
    line = F.lower(F.trim(F.regexp_replace("line", BLANKS, " ")))
    # keys first: made behind the explode, every line would hash its whole text
    rows = (docs.select(*row_key(), *_place(host), F.split(F.col("text").cast("string"), "\n").alias("_all"))
            .select(*ROW, F.posexplode("_all").alias("pos", "line"))
            .select(*ROW, "pos", line.alias("line")).where("line <> ''")
            .select(*ROW, "pos", F.xxhash64("line").alias("hash"), F.size(F.split("line", " ")).alias("words")))
    once = rows.groupBy(*ROW, "hash", "pos").agg(F.first("words").alias("words"))
    return once.groupBy(*ROW, "hash").agg(F.sum("words").alias("words"))


def frequent_lines(docs: DataFrame, max_docs: int = MAX_DOCS_PER_HOST, host: str = "source") -> DataFrame:
    """``_no, _host, hash`` of lines in more than ``max_docs`` documents of a host."""
    return _frequent(_lines(docs, host), max_docs)


def _frequent(lines: DataFrame, max_docs: int) -> DataFrame:
    counted = lines.groupBy("_no", "_host", "hash").agg(F.count("*").alias("docs"))
    return counted.where(F.col("docs") > max_docs).drop("docs")


def line_losses(docs: DataFrame, max_docs: int = MAX_DOCS_PER_HOST, host: str = "source") -> DataFrame:
    """``_uid, _th, _no, _host, lost_words, lost_lines, hashes``: what each
    document of a host loses."""
    lines = _lines(docs, host)
    met = lines.join(_frequent(lines, max_docs), ["_no", "_host", "hash"])
    return met.groupBy(*ROW).agg(F.sum("words").alias("lost_words"), F.count("*").alias("lost_lines"),
                                 F.collect_set("hash").alias("hashes"))


def quality(docs: DataFrame, max_docs: int = MAX_DOCS_PER_HOST, max_loss: float = MAX_LOSS, host: str = "source") -> DataFrame:
    """Verdict per row of ``docs(doc_id, text, <host>, ...)``: ``doc_id``, the
    base counts, ``lost_words``, ``depleted`` and ``kept``.

    NULL and empty texts have no words and fail the base rules. Rows equal in
    id, text and host count as one document, and each gets its verdict; the
    same id and text at two hosts is a document of each. A NULL host is a host
    of its own.
    Other columns, whatever their names, are not read.
    """
    slim = docs.select(*row_key(), *_place(host), "doc_id", F.col("text").cast("string").alias("text"))
    base = base_counts(slim).drop("text")
    lost = line_losses(docs.select("doc_id", "text", F.col(host).alias("host")), max_docs, "host").drop("hashes")
    out = base.join(lost, ROW, "left").withColumn("lost_words", F.coalesce("lost_words", F.lit(0).cast("long")))
    depleted = F.col("lost_words") > F.lit(max_loss) * F.col("n_words")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & ~depleted).alias("kept"), "lost_words", depleted.alias("depleted"))


def without_frequent_lines(docs: DataFrame, max_docs: int = MAX_DOCS_PER_HOST, max_loss: float = MAX_LOSS,
                           host: str = "source") -> DataFrame:
    """``docs`` with the frequent lines taken out of ``text``; depleted
    documents go."""
    lost = line_losses(docs, max_docs, host)
    rows = (docs.select(*row_key(), *_place(host), *[F.col(c).alias(f"in_{c}") for c in docs.columns])
            .join(lost, ROW, "left"))
    key = lambda x: F.xxhash64(F.lower(F.trim(F.regexp_replace(x, BLANKS, " "))))
    text = F.array_join(F.filter(F.split("in_text", "\n"), lambda x: ~F.array_contains("hashes", key(x))), "\n")
    whole = F.coalesce(F.col("lost_words") > F.lit(max_loss) * F.size(_words(F.col("in_text"))), F.lit(False))
    return rows.where(~whole).select(*[F.when(F.col("hashes").isNull(), F.col("in_text")).otherwise(text).alias(c) if c == "text"
                                       else F.col(f"in_{c}").alias(c) for c in docs.columns])
