"""Analytics over the meeting tables: KPIs, distributions, pivots, the
resolution shift, the churn index and account risk.

Aggregations group on low-cardinality keys with map-side partial
aggregation, so hot keys are combined before the shuffle. Per-meeting
positional logic goes through ``group_ordinals`` (range-partitioned, balanced
for huge meetings) instead of a window partitioned by meeting. Windows
without a partition key run only over already aggregated, small frames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import dictionaries as DICT
from ..dictionaries import DEFAULT, Dictionaries
from ..functions import classify as C
from ..functions import text as X
from ..session import written
from .ordering import global_top_k, group_ordinals, top_k_per_group
from .selection import FINISH_ROWS, values_at_ranks


# ------------------------------------------------------------ segment level
def resolution_shift(segments: DataFrame, meetings: DataFrame, rank_col: str | None = None,
                     count_col: str | None = None) -> DataFrame:
    """ALG1 (WIN1-WIN4): share of positive turns in a meeting's last third
    minus share of negative turns in its first third.

    Turns are numbered by (turn_index, id); the first third is rn <= n/3 and
    the last third n-rn+1 <= n/3 with real division, so meetings with fewer
    than three turns have empty thirds and drop out. One ordinal pass, then a
    single partially aggregated group-by computes both thirds. When the
    segments already carry that rank and the meeting's turn count (numbered
    upstream in the same order), pass their names to skip the ranking pass.
    """
    if rank_col and count_col:
        ranked = segments.select("meeting_id", "sentiment_type", F.col(rank_col).alias("_rn"),
                                 F.col(count_col).alias("_n"))
    else:
        seg = segments.select("meeting_id", "turn_index", "id", "sentiment_type")
        ranked = group_ordinals(seg, "meeting_id", ["turn_index", "id"], ordinal_col="_rn", size_col="_n")
    third = F.col("_n") / F.lit(3.0)
    first = F.col("_rn") <= third
    last = (F.col("_n") - F.col("_rn") + 1) <= third
    parts = (ranked.groupBy("meeting_id").agg(
        F.count_if(first & (F.col("sentiment_type") == "negative")).alias("_neg_first"),
        F.count_if(first).alias("_n_first"),
        F.count_if(last & (F.col("sentiment_type") == "positive")).alias("_pos_last"),
        F.count_if(last).alias("_n_last"))
        .filter((F.col("_n_first") > 0) & (F.col("_n_last") > 0)))
    pct_neg = F.col("_neg_first").cast("double") / F.col("_n_first").cast("double")
    pct_pos = F.col("_pos_last").cast("double") / F.col("_n_last").cast("double")
    scored = parts.select("meeting_id", pct_neg.alias("pct_neg_start"), pct_pos.alias("pct_pos_end"))
    out = (meetings.select("meeting_id", "title", "call_type",
                           F.col("sentiment_score").alias("overall_sentiment_score"))
           .join(scored, "meeting_id")
           .withColumn("resolution_shift", F.col("pct_pos_end") - F.col("pct_neg_start")))
    return out.orderBy(F.col("resolution_shift").desc(), F.col("meeting_id"))


def top_and_bottom(df: DataFrame, score: str, key: str, k: int = 5) -> DataFrame:
    """SRT4: the k highest and k lowest rows by ``score`` (ties by ``key``),
    labelled 'top' / 'bottom'; the bottom rows keep descending order."""
    top = global_top_k(df, [F.col(score).desc(), F.col(key)], k).withColumn("side", F.lit("top"))
    bottom = global_top_k(df, [F.col(score).asc(), F.col(key).desc()], k).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom)


def segment_stats(segments: DataFrame, d: Dictionaries = DEFAULT) -> DataFrame:
    """AGG19 + AGG21 per meeting: keyword hits (number of (sentence, keyword)
    pairs where the lower-cased sentence contains the keyword), negative,
    positive and total sentences."""
    low = F.lower(F.col("sentence"))
    hits = F.lit(0)
    for kw in d.risk_keywords:
        hits = hits + low.contains(kw.lower()).cast("int")
    return segments.groupBy("meeting_id").agg(
        F.sum(F.coalesce(hits, F.lit(0))).cast("long").alias("risk_keyword_count"),
        F.count_if(F.col("sentiment_type") == "negative").alias("negative_sentences"),
        F.count_if(F.col("sentiment_type") == "positive").alias("positive_sentences"),
        F.count(F.lit(1)).alias("total_sentences"))


def competitor_counts(entities: DataFrame) -> DataFrame:
    """AGG20: distinct competitors named per meeting."""
    return (entities.filter(F.col("entity_type") == "Competitor")
            .groupBy("meeting_id").agg(F.countDistinct("entity_name").alias("competitor_count")))


def churn_index(meetings: DataFrame, stats: DataFrame, competitors: DataFrame) -> DataFrame:
    """ALG2 (JOI6): composite churn risk per non-internal meeting.

    round(0.4*100*(5-score)/4 + 0.3*100*neg/total + 20*[competitors>0]
    + 10*[keyword hits>0], 1) with missing turn stats read as 0 / 1 / 0 and a
    NULL score giving NULL. Host and organizer are carried where known.
    """
    m = meetings.filter(F.col("call_type") != "Internal")
    j = (m.join(stats, "meeting_id", "left").join(competitors, "meeting_id", "left")
         .select("meeting_id", "title", *[c for c in ("host", "organizer_email") if c in m.columns], "overall_sentiment", "sentiment_score",
                 F.coalesce("risk_keyword_count", F.lit(0)).cast("long").alias("risk_keywords"),
                 F.coalesce("negative_sentences", F.lit(0)).cast("long").alias("negative_sentences"),
                 F.coalesce("total_sentences", F.lit(1)).cast("long").alias("total_sentences"),
                 F.coalesce("competitor_count", F.lit(0)).cast("long").alias("competitor_count")))
    raw = (F.lit(0.4) * (F.lit(100.0) * (F.lit(5.0) - F.col("sentiment_score")) / F.lit(4.0))
           + F.lit(0.3) * (F.lit(100.0) * F.col("negative_sentences").cast("double") / F.col("total_sentences").cast("double"))
           + F.when(F.col("competitor_count") > 0, F.lit(20.0)).otherwise(F.lit(0.0))
           + F.when(F.col("risk_keywords") > 0, F.lit(10.0)).otherwise(F.lit(0.0)))
    return j.withColumn("composite_risk_score", C.fixed_round(raw, 1))


def with_risk_tier(churn: DataFrame) -> DataFrame:
    """ALG3: Low/Medium/High on right-closed bins; out of range stays NULL."""
    return churn.withColumn("risk_tier", C.risk_tier("composite_risk_score"))


def tier_distribution(tiered: DataFrame) -> DataFrame:
    """AGG25: meetings per risk tier, every tier listed (zero when empty),
    rows without a tier left out."""
    spark = tiered.sparkSession
    tiers = spark.createDataFrame([(label, i) for i, (_, _, label) in enumerate(DICT.RISK_TIERS)],
                                  "risk_tier string, tier_order int")
    counts = tiered.filter(F.col("risk_tier").isNotNull()).groupBy("risk_tier").agg(F.count(F.lit(1)).alias("count"))
    return (F.broadcast(tiers).join(counts, "risk_tier", "left")
            .select("risk_tier", F.coalesce("count", F.lit(0)).cast("long").alias("count"), "tier_order")
            .orderBy("tier_order").drop("tier_order"))


def crosstab(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    """AGG17: counts of ``row`` x ``col`` with one column per value, zeros for
    empty cells, rows with a NULL label left out."""
    base = df.filter(F.col(row).isNotNull() & F.col(col).isin(*values))
    return base.groupBy(row).pivot(col, list(values)).agg(F.count(F.lit(1))).na.fill(0, subset=list(values))


def crosstab_share(ct: DataFrame, row: str, values: Sequence[str]) -> DataFrame:
    """AGG18: each cell as a percentage of its row total."""
    total = sum((F.col(v) for v in values), F.lit(0)).cast("double")
    return ct.select(row, *[(F.col(v).cast("double") / total * F.lit(100.0)).alias(v) for v in values])


# ------------------------------------------------------------ meeting level
def kpis(meetings: DataFrame) -> DataFrame:
    """AGG1: meeting count, average score (2 dp) and total hours (1 dp)."""
    return meetings.agg(
        F.count(F.lit(1)).alias("total_meetings"),
        C.fixed_round(F.avg("sentiment_score"), 2).alias("avg_sentiment"),
        C.fixed_round(F.sum("duration") / F.lit(60.0), 1).alias("total_hours"))


def count_by(df: DataFrame, key: str) -> DataFrame:
    """AGG2 / AGG3 / AGG23: rows per value of ``key`` (a NULL group is kept)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("count"))


def share_by(df: DataFrame, key: str, digits: int = 0) -> DataFrame:
    """AGG4 (WIN5): percent share of each group to ``digits`` places; the
    total is a window over the already aggregated groups."""
    counts = count_by(df, key)
    total = F.sum("count").over(Window.partitionBy())
    return counts.withColumn("pct", C.fixed_round(F.col("count") / total * F.lit(100.0), digits))


def account_stats(meetings: DataFrame, d: Dictionaries = DEFAULT) -> DataFrame:
    """AGG5 + ALG4: per account named in the title (unknown accounts
    excluded, internal calls included): risk from the unrounded average and
    the support-call count, average reported to 2 dp."""
    named = meetings.select(C.account_from_title("title", d).alias("customer"), "sentiment_score", "call_type")
    g = (named.filter(F.col("customer").isNotNull()).groupBy("customer").agg(
        F.avg("sentiment_score").alias("_avg"),
        F.count_if(F.col("call_type") == "Support").alias("support_calls"),
        F.count(F.lit(1)).alias("total_calls")))
    return account_report(g)


def account_report(g: DataFrame) -> DataFrame:
    """Risk and rounded average of ``customer, _avg, support_calls, total_calls``."""
    return g.select("customer", C.account_risk("_avg", "support_calls").alias("risk"),
                    C.fixed_round("_avg", 2).alias("avg_sentiment"), "support_calls", "total_calls")


def account_risk_top(stats: DataFrame, k: int = DICT.TOP_ACCOUNTS) -> DataFrame:
    """SRT2: High, Medium, Low, then by rounded average ascending; first k."""
    return global_top_k(stats, [C.ordered_rank("risk", DICT.RISK_ORDER), F.col("avg_sentiment"), F.col("customer")], k)


def filter_accounts(stats: DataFrame, name_query: str = "", risk: str = "All") -> DataFrame:
    """FIL13: account name contains the query (case-insensitive) and the risk
    equals the chosen level, or any level for 'All'."""
    cond = F.lower(F.col("customer")).contains(name_query.lower())
    if risk != "All":
        cond = cond & (F.col("risk") == risk)
    return stats.filter(cond)


def sort_by(df: DataFrame, key: str, ascending: bool, tiebreak: str) -> DataFrame:
    """SRT8: user-chosen sort key and direction (tiebreak for determinism)."""
    k = F.col(key).asc() if ascending else F.col(key).desc()
    return df.orderBy(k, F.col(tiebreak))


def daily_timeline(meetings: DataFrame, days: int = DICT.TIMELINE_DAYS) -> DataFrame:
    """AGG8: average score (2 dp) and meeting count per calendar day of the
    start time; the last ``days`` active days, ascending (a NULL day sorts
    last, as in the reference)."""
    g = meetings.groupBy(F.to_date("start_time").alias("date")).agg(
        F.avg("sentiment_score").alias("_avg"), F.count(F.lit(1)).alias("count"))
    return last_days(g, days)


def last_days(g: DataFrame, days: int = DICT.TIMELINE_DAYS) -> DataFrame:
    """The timeline of ``date, _avg, count``."""
    last = global_top_k(g, [F.col("date").desc_nulls_first()], days)
    # the day is reported as ISO text, as the dashboard returns it
    return (last.orderBy(F.col("date").asc_nulls_last())
            .select(F.date_format("date", "yyyy-MM-dd").alias("date"), C.fixed_round("_avg", 2).alias("sentiment"),
                    "count"))


def score_summary(meetings: DataFrame, group: str = "call_type", value: str = "sentiment_score",
                  approx: bool = False) -> DataFrame:
    """AGG15: count, mean, sample std, min, quartiles (linear interpolation),
    max of ``value`` per ``group``; statistics reported to 6 places. With
    ``approx`` the quartiles come from a mergeable sketch
    (``percentile_approx``) in the same single aggregation."""
    q = approx_quartiles(meetings, group, value) if approx else exact_quartiles(meetings, group, value)
    m = meetings.filter(F.col(value).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("count"), F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_std"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    return (m.join(q, group)
            .select(group, "count", C.six_places("_mean").alias("mean"), C.six_places("_std").alias("std"),
                    "min", C.six_places("q25").alias("q25"), C.six_places("q50").alias("q50"),
                    C.six_places("q75").alias("q75"), "max"))


def exact_quartiles(df: DataFrame, group: str, value: str, probs=(0.25, 0.5, 0.75),
                    finish_rows: int = FINISH_ROWS) -> DataFrame:
    """Exact linear-interpolated quantiles per group: the two ranks around
    each position 1+(n-1)p are selected by narrowing value intervals, so a
    group's values are neither sorted nor gathered, then interpolated."""
    sizes = written(df.filter(F.col(value).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("size")))
    at = {f"{int(round(p * 100)):02d}": F.lit(1.0) + (F.col("size") - 1).cast("double") * F.lit(p) for p in probs}
    ends = [F.struct(F.lit(end + tag).alias("tag"), f(pos).alias("rank"))
            for tag, pos in at.items() for end, f in (("lo", F.floor), ("hi", F.ceil))]
    wanted = sizes.select(group, "size", F.explode(F.array(*ends)).alias("e")).select(group, "size", "e.*")
    found = values_at_ranks(df, group, value, wanted, finish_rows).groupBy(F.col(group).alias("_k")).agg(
        *[F.max(F.when(F.col("tag") == end + tag, F.col("x"))).alias(f"_{end}{tag}") for tag in at for end in ("lo", "hi")])
    both = sizes.join(found, F.col(group).eqNullSafe(F.col("_k")))
    return both.select(group, *[
        (F.col(f"_lo{tag}") + (F.col(f"_hi{tag}") - F.col(f"_lo{tag}")) * (pos - F.floor(pos))).alias(f"q{tag}")
        for tag, pos in at.items()])


def approx_quartiles(df: DataFrame, group: str, value: str, accuracy: int = 10_000) -> DataFrame:
    """Quartiles per group from a mergeable quantile sketch: one partially
    aggregated pass, bounded memory per group, rank error about 1/accuracy."""
    pq = F.percentile_approx(value, [0.25, 0.5, 0.75], accuracy)
    return (df.filter(F.col(value).isNotNull()).groupBy(group).agg(pq.alias("_q"))
            .select(group, F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("q50"), F.col("_q")[2].alias("q75")))


def box_stats(meetings: DataFrame, group: str = "call_type", value: str = "sentiment_score") -> DataFrame:
    """AGG16: quartiles, IQR, whiskers (most extreme values within 1.5 IQR of
    the box) and the number of outliers per group."""
    q = exact_quartiles(meetings, group, value)
    j = meetings.select(group, value).filter(F.col(value).isNotNull()).join(q, group)
    iqr = F.col("q75") - F.col("q25")
    lo_fence = F.col("q25") - F.lit(1.5) * iqr
    hi_fence = F.col("q75") + F.lit(1.5) * iqr
    inside = (F.col(value) >= lo_fence) & (F.col(value) <= hi_fence)
    g = j.groupBy(group, "q25", "q50", "q75").agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"))
    return g.select(group, C.six_places("q25").alias("q25"), C.six_places("q50").alias("q50"),
                    C.six_places("q75").alias("q75"), C.six_places(F.col("q75") - F.col("q25")).alias("iqr"),
                    "whisker_low", "whisker_high", "outliers")


def duration_histogram(meetings: DataFrame, bins: int = DICT.HISTOGRAM_BINS) -> DataFrame:
    """AGG24 (ENR19): equal-width histogram of duration/60 over the global
    range, stacked by call type. The range comes from scalar subqueries
    (one tiny aggregate each), so no join is needed."""
    x = F.col("duration") / F.lit(60.0)
    vals = meetings.select(x.alias("x"), "call_type").filter(F.col("x").isNotNull())
    lo = vals.select(F.min("x")).scalar()
    hi = vals.select(F.max("x")).scalar()
    width = (hi - lo) / F.lit(float(bins))
    b = F.when(width > 0, F.least(F.floor(F.try_divide(F.col("x") - lo, width)), F.lit(bins - 1))).otherwise(F.lit(0))
    g = vals.groupBy(b.cast("int").alias("bin"), "call_type").agg(F.count(F.lit(1)).alias("count"))
    return g.select("bin", "call_type", "count",
                    (lo + F.col("bin").cast("double") * width).alias("bin_start"),
                    (lo + (F.col("bin") + 1).cast("double") * width).alias("bin_end"))


def hours(meetings: DataFrame) -> DataFrame:
    """ENR19: the stored duration is in minutes; /60 gives hours."""
    return meetings.withColumn("duration_hours", F.col("duration") / F.lit(60.0))


# --------------------------------------------------------------- topic level
def topics_matching(topics: DataFrame, patterns: Sequence[str], k: int = DICT.TOP_TOPICS) -> DataFrame:
    """AGG6 / AGG7 (FIL7 / FIL8): top-k topics (by meeting count, ties by
    name) whose text contains any pattern, case-sensitive."""
    g = (topics.filter(X.contains_any("topic", patterns)).groupBy("topic")
         .agg(F.count(F.lit(1)).alias("count")))
    return global_top_k(g, [F.col("count").desc(), F.col("topic")], k)


def topics_by_section(topics: DataFrame, sections: dict[str, Sequence[str]], k: int = DICT.TOP_TOPICS) -> DataFrame:
    """``topics_matching`` for several named pattern lists in one pass:
    ``section, topic, count``, the first ``k`` topics of each section. A topic
    row counts once in every section it matches."""
    own = F.array(*[F.when(X.contains_any("topic", patterns), F.lit(name)) for name, patterns in sections.items()])
    g = (topics.select(F.explode(F.array_compact(own)).alias("section"), "topic").groupBy("section", "topic")
         .agg(F.count(F.lit(1)).alias("count")))
    return top_k_per_group(g, "section", [F.col("count").desc(), F.col("topic")], k).drop("rank")


def meeting_groups(meetings: DataFrame, d: Dictionaries = DEFAULT) -> DataFrame:
    """All meetings together and by call type, sentiment, account of the title
    and day, in one aggregation: ``part`` tells which (``all, call_type,
    sentiment, customer, day``), with ``count, _avg, minutes, support_calls``."""
    keys = {"call_type": F.col("call_type"), "sentiment": F.col("overall_sentiment"),
            "customer": C.account_from_title("title", d), "day": F.to_date("start_time")}
    base = meetings.select(*[c.alias(k) for k, c in keys.items()], "sentiment_score", "duration",
                           (F.col("call_type") == "Support").alias("_support"))
    g = (base.groupingSets([[], *[[F.col(k)] for k in keys]], *keys)
         .agg(F.grouping_id().alias("_gid"), F.count(F.lit(1)).alias("count"), F.avg("sentiment_score").alias("_avg"),
              F.sum("duration").alias("minutes"), F.count_if("_support").alias("support_calls")))
    part, every = F.lit("all"), (1 << len(keys)) - 1
    for i, k in enumerate(keys):  # a set bit of the id is a key that isn't grouped by
        part = F.when(F.col("_gid") == every - (1 << (len(keys) - 1 - i)), F.lit(k)).otherwise(part)
    return g.select(part.alias("part"), *keys, "count", "_avg", "minutes", "support_calls")


def product_priorities(issues: DataFrame, features: DataFrame, tab: str = "all", query: str = "") -> DataFrame:
    """ALG5 (SET3, AGG27, FIL15, SRT10): issues and features tagged and
    concatenated, each carrying the overall maximum volume, filtered by tab
    and a case-insensitive name substring, by volume descending."""
    both = (issues.select(F.col("topic").alias("name"), F.lit("bug").alias("type"), F.col("count").alias("volume"))
            .unionByName(features.select(F.col("topic").alias("name"), F.lit("feature").alias("type"),
                                         F.col("count").alias("volume"))))
    both = both.withColumn("max_volume", F.coalesce(F.max("volume").over(Window.partitionBy()), F.lit(1)))
    cond = F.lower(F.col("name")).contains(query.lower())
    if tab != "all":
        cond = cond & (F.col("type") == tab)
    return both.filter(cond).orderBy(F.col("volume").desc(), F.col("type"), F.col("name"))


def topic_call_type_counts(topics: DataFrame, meetings: DataFrame) -> DataFrame:
    """AGG12 (JOI1): topic rows per (topic, call type)."""
    return (topics.join(meetings.select("meeting_id", "call_type"), "meeting_id")
            .groupBy("topic", "call_type").agg(F.count(F.lit(1)).alias("count")))


def topic_pivot(counts: DataFrame, call_types: Sequence[str] = DICT.CALL_TYPES) -> DataFrame:
    """AGG13: topic x call type with zeros and a Total column, by Total
    descending."""
    p = (counts.filter(F.col("call_type").isin(*call_types)).groupBy("topic")
         .pivot("call_type", list(call_types)).agg(F.sum("count")).na.fill(0, subset=list(call_types)))
    p = p.select("topic", *[F.col(c).cast("long").alias(c) for c in call_types])
    total = sum((F.col(c) for c in call_types), F.lit(0)).cast("long")
    return p.withColumn("Total", total).orderBy(F.col("Total").desc(), F.col("topic"))


def topic_totals(counts: DataFrame, k: int = 12) -> DataFrame:
    """AGG14: topics by total count over call types, first k."""
    g = counts.groupBy("topic").agg(F.sum("count").cast("long").alias("count"))
    return global_top_k(g, [F.col("count").desc(), F.col("topic")], k)


# ---------------------------------------------------------------- entities
def mention_counts(entities: DataFrame, entity_type: str) -> DataFrame:
    """AGG9 / AGG10 (FIL17): meetings naming each entity of a type."""
    return (entities.filter(F.col("entity_type") == entity_type).groupBy("entity_name")
            .agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), F.col("entity_name")))


def competitor_meetings(entities: DataFrame, meetings: DataFrame) -> DataFrame:
    """AGG11 (JOI2): every meeting naming each competitor, newest first,
    with the competitor's meeting count; one join for all competitors,
    returned flat (one row per competitor and meeting) instead of a nested
    list, so no group is gathered into one row."""
    comp = entities.filter(F.col("entity_type") == "Competitor").select(F.col("entity_name").alias("competitor"), "meeting_id")
    counts = comp.groupBy("competitor").agg(F.count(F.lit(1)).alias("mentions"))
    rows = comp.join(meetings.select("meeting_id", "title", F.col("overall_sentiment").alias("sentiment"),
                                     "sentiment_score", "call_type", "start_time"), "meeting_id")
    # one row per competitor name: broadcast by its size at run time, beyond
    # that a join whose hot competitors are split
    return (rows.join(counts, "competitor")
            .orderBy(F.col("mentions").desc(), F.col("competitor"), F.col("start_time").desc(), F.col("meeting_id")))


# ------------------------------------------------------------- action items
def owner_workload(items: DataFrame, k: int = 10) -> DataFrame:
    """AGG22: action items per owner ('Unassigned' included), first k."""
    g = items.groupBy("owner").agg(F.count(F.lit(1)).alias("count"))
    return global_top_k(g, [F.col("count").desc(), F.col("owner")], k)
