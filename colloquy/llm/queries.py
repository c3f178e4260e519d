"""The registered queries of this sub-package: each applies one operator,
with its production parameters, to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import (
    chat, decontamination, digest_history, line_dedup, line_frequency, lsh_forest, masked_lm, packing,
    periodic_runs, phrase_mining, pii, secrets, toxicity,
)
from .common import read

TOKENIZER = "word_bpe_49k.json"
PII_KEY = "colloquy"  # a deployment sets its own


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.replace_pii(read(spark, sf_dir, "documents"), PII_KEY)
    return out.select("doc_id", "n_entities", "text")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated_regions(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # which lines are left says which text is left; texts are rebuilt where
    # they are needed, in the pipeline
    out = line_dedup.dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "kept_lines", "depleted")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.jaccard_join(read(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.score(read(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.quality(read(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(read(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a finished conversation is a log of one message event per row; rows that
    # share a turn or have none keep places of their own
    said = "\\### Assistant: </turn> ok"
    hard = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    place = Window.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    events = rows.withColumn("turn", F.row_number().over(place)).withColumn("seq", F.col("turn")).withColumn("kind", F.lit("message"))
    return chat.digest(chat.render(chat.fold_events(events)))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    scored = toxicity.toxicity(docs, labels)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"),
                         F.col("toxicity_score").alias("score"),
                         (F.col("toxicity_score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "toxic_passages")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_history.exact_dedup(read(spark, sf_dir, "documents"))


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.collocations(read(spark, sf_dir, "documents"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` where, in texts whose id has crc32 0 modulo 10, the
    words from one on are those of a first period over and over."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.array_remove(F.split("text", digest_history.BLANKS), ""))
    own = docs.select("doc_id", "text", words.alias("w"), F.floor(h / 10).alias("g"))
    own = own.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    own = own.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    again = F.expr("slice(flatten(array_repeat(slice(w, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a)")
    return own.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.concat(F.expr("slice(w, 1, a)"), again), " "))
                      .otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(with_planted_periods(read(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    told = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    out = found.select("doc_id", "runs", "collapsed", best.alias("b"), told.alias("told"))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("b.s")).alias("start"), F.col("b.length").alias("length"),
        (-F.col("b.q")).alias("period"), F.expr("(1000 * b.length) div (-b.q)").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("told", lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_pii_surrogates, op2_best_fit_packing, op3_benchmark_decontamination, op4_line_dedup, op5_ngram_jaccard_join,
        op6_lm_scoring, op7_quality_rules, op8_secret_scan, op9_chat_formatting, op10_toxicity,
        op11_exact_dedup, op12_phrase_mining, op13_periodic_runs,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op11_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents
        )
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
               row_number() OVER w = 1 AS kept, h AS text_sha256,
               coalesce(first_value(doc_id) OVER w
                        <= (SELECT min(doc_id) + (max(doc_id) - min(doc_id)) // 2 FROM documents), false) AS in_history
        FROM d WINDOW w AS (PARTITION BY h ORDER BY doc_id NULLS LAST)
    """,
    "op12_phrase_mining": r"""
        WITH texts AS (
            SELECT coalesce(lang, 'und') AS lang,
                   translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
        ), pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM texts),
        lists AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
        totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM lists GROUP BY lang),
        sizes AS (SELECT unnest(range(1, 6)) AS k),
        places AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM lists, sizes),
        freq AS (
            SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, any_value(w[i:i + k - 1]) AS w, k, count(*) AS f
            FROM places GROUP BY 1, 2, k HAVING count(*) >= 100
        ), cuts AS (SELECT lang, phrase, w, k, f AS a, unnest(range(1, k)) AS c FROM freq WHERE k > 1),
        scored AS (
            SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, t.n,
                   ((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score,
                   row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY (1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f), c.c) AS place
            FROM cuts c JOIN totals t ON c.lang = t.lang
            JOIN freq x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.c], ' ')
            JOIN freq y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.c + 1:], ' ')
        ), starts AS (SELECT lang, w, k, f, unnest(range(1, k)) AS i FROM freq WHERE k > 2),
        ends AS (SELECT lang, w, k, f, i, unnest(range(i + 1, k + 1)) AS j FROM starts),
        inside AS (
            SELECT lang, array_to_string(w[i:j], ' ') AS phrase, max(f) AS f FROM ends WHERE j - i + 1 < k GROUP BY 1, 2
        ), ranked AS (
            SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank
            FROM scored s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase
            WHERE place = 1 AND (i.f IS NULL OR 100 * i.f < 100 * s.a)
        )
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
    """,
}
