"""Line dedup by exact set-similarity join.

A line is the set of its lower-cased, blank-separated words. Words are put in
one corpus-wide order, rarest first; two sets with Jaccard similarity ``t``
share a word among the first ``n - ceil(t n) + 1`` of the larger and the first
``n - ceil(2 t n / (1 + t)) + 1`` of the smaller, so only those prefixes are
joined. Candidates pass a length, a positional and a bitmap filter and are
verified on the whole sets. A line goes when an earlier line, by document id
and line number, is that similar.

One similar earlier line is enough for a line to go, so lines are first held
against the earliest line that shares a mark (two of its extreme word hashes):
at most ``MARKS`` comparisons each, which settles most of a large group of
near copies. The prefix join then looks only at pairs whose later line is not
settled so; it goes over the prefixes in ``ROUNDS``
shares of the words, each with files of its own. What the marks miss, it finds.

Everything is DataFrame code. Rarity comes from word counts over the whole
corpus, kept in a table of fixed size (``RARITY_SLOTS``), so lines can be
ordered where they are read; the order need only be the same everywhere for
the join to be exact, which it is.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, maybe_needed, only_needed, row_key

THRESHOLD = 0.8
RARITY_BITS = 17
RARITY_SLOTS = 1 << RARITY_BITS
LONGEST = (1 << 16) - 1
MARKS = 3
# the prefix join shuffles one share of the words after the other
ROUNDS = 2
_EPS = 1e-9


def _words(text: Column) -> Column:
    """The lower-cased words between blanks, tabs and carriage returns, and
    empty strings. Splitting at one character needs no pattern matching."""
    spaced = F.replace(F.replace(text, F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    return F.split(F.lower(spaced), " ")


def _hashes(text: Column) -> Column:
    return F.array_remove(F.transform(_words(text), lambda w: F.xxhash64(w)), F.xxhash64(F.lit("")))


def rarity(docs: DataFrame, text: str = "text") -> Column:
    """Classes of the word slots by their count over all texts, half an
    octave each, as a constant array column: the class of slot ``s`` at
    index ``s``."""
    lines = F.replace(F.col(text).cast("string"), F.lit("\n"), F.lit(" "))
    counts = (docs.select(F.explode(_words(lines)).alias("w")).where("w <> ''").select(_slot(F.xxhash64("w")).alias("slot"))
              .groupBy("slot").agg(F.count("*").alias("n")).collect())  # at most RARITY_SLOTS rows
    classes = [0] * RARITY_SLOTS
    for row in counts:
        classes[row["slot"]] = int(2 * math.log2(row["n"]))
    return F.split(F.lit(",".join(map(str, classes))), ",").cast("array<tinyint>")


def _slot(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - RARITY_BITS).cast("int")


def _set(line: Column) -> Column:
    """The hashes of a line's distinct words."""
    return F.array_distinct(_hashes(line))


def _coded(hashes: Column, classes: Column) -> Column:
    """A set of word hashes as sorted codes: the rarity class of the word's
    slot, then 55 bits of its hash, so ascending codes are rarest first.
    Equal words have equal codes in every line."""
    low = F.lit((1 << 55) - 1).cast("bigint")
    return F.sort_array(F.transform(hashes, lambda h: F.shiftleft(
        F.coalesce(F.get(classes, _slot(h)), F.lit(0).cast("tinyint")).cast("bigint"), 55).bitwiseOR(h.bitwiseAND(low))))


def _lines(docs: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """``_uid, _th, pos, line``. The key is made before the lines are taken
    apart: made behind that, every line would carry and hash its whole text.
    Texts that surely hold no line of ``wanted`` are not taken apart."""
    rows = docs.select(*row_key(), "text")
    if wanted is not None:
        rows = maybe_needed(rows, wanted, ["_uid", "_th"])
    return (rows.select("_uid", "_th", F.split("text", "\n").alias("_lines"))
            .select("_uid", "_th", F.posexplode("_lines").alias("pos", "line")))


def line_rows(docs: DataFrame, ranks: Column) -> DataFrame:
    """One row per line with words: ``_uid, _th, pos``, its sorted word
    ``hashes`` and the same as ``codes``."""
    lines = _lines(docs).where(F.trim("line", F.lit(" \t\r")) != "")
    return (lines.select("_uid", "_th", "pos", F.sort_array(_set(F.col("line"))).alias("hashes"))
            .withColumn("codes", _coded(F.col("hashes"), ranks)))


def _bitmap(codes: Column, odd: int) -> Column:
    """One half of the parity bitmap of a set, of 128 bits: sets that differ
    in k words differ in at most k bits."""
    codes = F.filter(codes, lambda c: F.shiftright(c, 6).bitwiseAND(F.lit(1)) == odd)
    return F.aggregate(codes, F.lit(0).cast("bigint"),
                       lambda acc, c: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), c.bitwiseAND(F.lit(63)).cast("int"))))


def _marks(hashes: str) -> Column:
    """Hashes of pairs of a set's extreme word hashes, as in a bottom sketch:
    similar sets mostly share one. ``hashes``: sorted."""
    end = lambda k: F.try_element_at(F.col(hashes), F.lit(k))
    return F.array(F.hash(F.lit(0), end(1), end(2)), F.hash(F.lit(1), end(-1), end(-2)), F.hash(F.lit(2), end(1), end(-1)))


def line_classes(lines: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Distinct word sets: ``h1, h2`` (128-bit identity), ``n`` words, the
    first line that has it, prefix, marks and bitmap."""
    n = F.size("codes")
    prefix = F.slice("codes", F.lit(1), n - F.ceil(n * F.lit(threshold) - _EPS).cast("int") + 1)
    carried = {"n": n, "prefix": F.transform(prefix, lambda c: F.hash(c)), "marks": _marks("hashes"),
               "even": _bitmap(F.col("codes"), 0), "odd": _bitmap(F.col("codes"), 1)}
    keyed = lines.select(F.xxhash64("codes").alias("h1"), F.xxhash64(F.lit("line"), "codes").alias("h2"),
                         F.struct("_uid", "_th", "pos").alias("at"), *[c.alias(k) for k, c in carried.items()])
    return keyed.groupBy("h1", "h2").agg(F.min("at").alias("first"), *[F.first(k).alias(k) for k in carried])


def _long_enough(na: Column, nb: Column, threshold: float) -> Column:
    """Length filter; ``na`` is the larger size."""
    return nb >= F.lit(threshold) * na - _EPS


def _may(na: Column, nb: Column, a: str, b: str, threshold: float) -> Column:
    """Bitmap filter; ``a`` and ``b`` are what the names of the sides' bitmaps
    begin with."""
    differ = F.bit_count(F.col(f"{a}even").bitwiseXOR(F.col(f"{b}even"))) + F.bit_count(F.col(f"{a}odd").bitwiseXOR(F.col(f"{b}odd")))
    return (na + nb - differ) / 2 >= F.lit(threshold / (1 + threshold)) * (na + nb) - _EPS


def _side(classes: DataFrame, s: str, *more: str) -> DataFrame:
    """The columns of a pair's side, ``h1`` as ``a1`` and so on."""
    return classes.select(*[F.col(k).alias(s + k.removeprefix("h")) for k in ("h1", "h2", "n", "first", *more)])


def _with_sides(pairs: DataFrame, classes: DataFrame, *more: str) -> DataFrame:
    """``pairs`` of ``a1, b1`` with the columns of both sides; only classes in
    a pair are shuffled for it."""
    ends = pairs.select(F.explode(F.array("a1", "b1")).alias("h1")).distinct()
    sides = only_needed(classes.select("h1", "h2", "n", "first", *more), ends, ["h1"])
    return pairs.join(_side(sides, "a", *more), "a1").join(_side(sides, "b", *more), "b1")


def _with_earliest(classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs of a class (``b``) with the earliest class of one of its marks
    (``a``): at most MARKS pairs per class. What the filters need is shuffled
    by mark, once, so pairs that fail them go no further."""
    marked = classes.select("h1", "n", "even", "odd", F.col("first._uid").alias("uid"), F.explode("marks").alias("mark"))
    least = marked.groupBy("mark").agg(F.min("uid").alias("least"), F.count("*").alias("size")).where("size > 1").drop("size")
    shared = marked.join(least, "mark")
    heads = shared.where("uid = least").groupBy("mark").agg(F.min(F.struct("h1", "n", "even", "odd")).alias("head"))
    met = (shared.join(heads, "mark")
           .select(F.col("h1").alias("b1"), F.col("n").alias("bn"), F.col("even").alias("beven"), F.col("odd").alias("bodd"),
                   F.col("head.h1").alias("a1"), F.col("head.n").alias("an"), F.col("head.even").alias("aeven"), F.col("head.odd").alias("aodd"))
           .where((F.col("a1") != F.col("b1")) & _long_enough(F.greatest("an", "bn"), F.least("an", "bn"), threshold)
                  & _may(F.col("an"), F.col("bn"), "a", "b", threshold)))
    return (_with_sides(keep(met.select("a1", "b1").distinct(), release=True), classes).where("afirst < bfirst")
            .select("a1", "a2", "b1", "b2", "an", "bn", "afirst", "bfirst"))


def _candidates(classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs of classes that pass the prefix, length, positional and bitmap
    filters, each once, whose later class is not ``settled``. The joined rows
    carry what the filters need, so what fails them is never shuffled.

    A pair's rows are its shared prefix words. Of two prefixes, one ends
    first in the common order and meets no word behind the other, so the sets
    share at most these words and the longer rest; pairs that cannot reach the
    threshold so are left out before anything is fetched for them."""
    # word hash, set size, position and whether the class is settled share one
    # integer: sizes stop at LONGEST, and sets of that size pass the filters
    key = (F.shiftleft(F.col("tok").cast("bigint"), 32)
           .bitwiseOR(F.shiftleft(F.least("n", F.lit(LONGEST)).cast("bigint"), 16))
           .bitwiseOR(F.shiftleft(F.least("p", F.lit((1 << 15) - 1)).cast("bigint"), 1))
           .bitwiseOR(F.col("settled").cast("bigint")))
    rows = (classes.select("h1", "even", "odd", "n", "settled", F.col("first._uid").alias("uid"), F.posexplode("prefix").alias("p", "tok"))
            .select("tok", key.alias("key"), "h1", "even", "odd", "uid"))
    n = lambda s: F.shiftright(F.col(f"{s}.key"), 16).bitwiseAND(F.lit(LONGEST))
    p = lambda s: F.shiftright(F.col(f"{s}.key"), 1).bitwiseAND(F.lit((1 << 15) - 1))
    # words of a prefix's set behind it: a is the larger set, b the smaller
    rest_a = F.ceil(n("a") * F.lit(threshold) - _EPS) - 1
    rest_b = F.ceil(n("b") * F.lit(2 * threshold / (1 + threshold)) - _EPS) - 1
    # words before this shared one may all be shared too, words after likewise
    most = F.least(p("a"), p("b")) + F.least(n("a") - p("a"), n("b") - p("b"))
    long = n("a") == LONGEST
    need = F.lit(threshold / (1 + threshold)) * (n("a") + n("b")) - _EPS
    larger = (n("a") > n("b")) | ((n("a") == n("b")) & F.expr("a.h1 < b.h1"))
    # what costs least and fails most comes first
    may = long | (_long_enough(n("a"), n("b"), threshold) & (most >= need) & (p("b") < n("b") - rest_b) & _may(n("a"), n("b"), "a.", "b.", threshold))
    # of documents that share an id, which line is later is seen below
    open_ = F.expr("(a.key & b.key & 1) = 0 AND (a.uid >= b.uid OR (b.key & 1) = 0) AND (a.uid <= b.uid OR (a.key & 1) = 0)")
    on = F.expr("a.key >> 32 = b.key >> 32") & larger & may & open_
    least = F.when(long, F.lit(0.0)).otherwise(need - F.greatest(rest_a, rest_b))
    met = []
    for share in range(ROUNDS):
        part = rows.where(F.pmod("tok", F.lit(ROUNDS)) == share).drop("tok")
        joined = part.alias("a").join(part.alias("b"), on)
        met.append(keep(joined.select(F.col("a.h1").alias("a1"), F.col("b.h1").alias("b1"), least.alias("least")), release=True))
    pairs = keep(reduce(DataFrame.unionByName, met).groupBy("a1", "b1").agg(F.count("*").alias("met"), F.max("least").alias("least"))
                 .where("met >= least").select("a1", "b1"), release=True)
    return (_with_sides(pairs, classes, "settled").where("NOT CASE WHEN afirst < bfirst THEN bsettled ELSE asettled END")
            .select("a1", "a2", "b1", "b2", "an", "bn", "afirst", "bfirst"))


def verified(docs: DataFrame, candidates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Similar pairs ``a1, a2, b1, b2, afirst, bfirst, shared, jaccard`` among
    ``candidates``, by their whole sets."""
    cand = keep(candidates, release=True)
    ends = (cand.select(F.explode(F.array(F.struct(F.col("a1").alias("h1"), F.col("a2").alias("h2"), F.col("afirst").alias("first")),
                                          F.struct(F.col("b1").alias("h1"), F.col("b2").alias("h2"), F.col("bfirst").alias("first")))).alias("e"))
            .select("e.h1", "e.h2", "e.first._uid", "e.first._th", "e.first.pos").distinct())
    lines = _lines(docs, ends)
    # both sides read the one exchange by (h1, h2)
    sets = (only_needed(lines, ends, ["_uid", "_th", "pos"])
            .select("h1", "h2", _set(F.col("line")).alias("words")).dropDuplicates(["h1", "h2"]))
    side = lambda s: sets.select(F.col("h1").alias(f"{s}1"), F.col("h2").alias(f"{s}2"), F.col("words").alias(f"{s}words"))
    shared = F.size(F.array_intersect("awords", "bwords"))
    return (cand.join(side("a"), ["a1", "a2"]).join(side("b"), ["b1", "b2"])
            .withColumn("shared", shared)
            .withColumn("jaccard", F.col("shared") / (F.col("an") + F.col("bn") - F.col("shared")))
            .where(F.col("jaccard") >= F.lit(threshold) - _EPS)
            .select("a1", "a2", "b1", "b2", "afirst", "bfirst", "shared", "jaccard"))


def _later(pairs: DataFrame) -> DataFrame:
    """``h1, h2`` of the later class of each pair, each once."""
    later = F.when(F.col("afirst") < F.col("bfirst"), F.struct(F.col("b1").alias("h1"), F.col("b2").alias("h2"))).otherwise(
        F.struct(F.col("a1").alias("h1"), F.col("a2").alias("h2")))
    return pairs.select(later.alias("e")).select("e.h1", "e.h2").distinct()


def kept_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``_uid, _th, kept``: sorted numbers of the lines of each document that
    have words and match no earlier line."""
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    ranks = rarity(slim)
    classes = keep(line_classes(line_rows(slim, ranks), threshold), release=True)
    settled = keep(_later(verified(slim, _with_earliest(classes, threshold), threshold)), release=True)
    known = keep(classes.drop("marks").join(settled.withColumn("settled", F.lit(True)), ["h1", "h2"], "left")
                 .withColumn("settled", F.coalesce("settled", F.lit(False))), release=True)
    found = keep(_later(verified(slim, _candidates(known, threshold), threshold)), release=True)
    return (known.where(~F.col("settled")).join(found, ["h1", "h2"], "left_anti").select("first.*")
            .groupBy("_uid", "_th").agg(F.sort_array(F.collect_list("pos")).alias("kept")))


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the later matches taken out of ``text``, plus
    ``n_lines`` (before), ``kept_lines`` (numbers of the lines left) and
    ``depleted`` (it had words and none are left).

    A line without words is neither a match nor removed. NULL texts stay
    NULL, with no lines. Rows with the same id and text are one document's
    repeats: they keep the same lines. A NULL id orders first. Ties cannot
    arise otherwise: lines differ in id, content or number.
    """
    kept = kept_lines(docs, threshold)
    extra = [c for c in docs.columns if c != "text"]
    # numbers of lines without words, NULL for the others; made before the
    # join, so that a text nobody asks for is not shuffled
    spots = F.transform(F.split("text", "\n"), lambda line, i: F.when(F.trim(line, F.lit(" \t\r")) == "", i))
    rows = (docs.select(*row_key(), *[F.col(c).alias(f"in_{c}") for c in extra], F.col("text").cast("string").alias("text"))
            .withColumn("spots", spots).withColumn("n_lines", F.size("spots"))
            .withColumn("blank", F.array_compact("spots")).drop("spots"))
    joined = (rows.join(kept, ["_uid", "_th"], "left")
              .withColumn("left", F.array_sort(F.array_union(F.coalesce("kept", F.array().cast("array<int>")), "blank")))
              .withColumn("lines", F.split("text", "\n")))
    out = F.when(F.size("left") == F.size("lines"), F.col("text")).otherwise(
        F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n"))
    return joined.select(*[F.col(f"in_{c}").alias(c) if c != "text" else F.when(F.col("text").isNotNull(), out).alias("text")
                           for c in docs.columns],
                         F.greatest("n_lines", F.lit(0)).alias("n_lines"),
                         F.coalesce("left", F.array().cast("array<int>")).alias("kept_lines"),
                         (F.col("kept").isNull() & (F.size("blank") < F.col("n_lines"))).alias("depleted"))


def without_repeated_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with later matching lines removed and ``n_chars``, if there,
    recounted; documents of which nothing with a word is left go."""
    out = dedup_lines(docs, threshold).where(~F.coalesce("depleted", F.lit(False)))
    if "n_chars" in docs.columns:
        changed = F.size("kept_lines") < F.col("n_lines")
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
