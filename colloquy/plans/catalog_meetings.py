"""Queries over the meetings table (binding B3): KPIs, breakdowns, account
risk, timeline, score statistics, histogram, list filters and paging,
call-type and account enrichment, dashboard bundle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as X
from ..operators import analytics as A
from ..operators import filters as FL
from ..sources import bindings as B
from ..sources.tables import read_table
from . import sqltext as Q
from .registry import register

M_SQL = {"m": "SELECT * FROM b3_meetings"}


def _m(spark, root):
    return B.b3_meetings(spark, root)


def _listed(spark, root):
    """Whole meetings, with their summary, which the list filters search as well."""
    return B.with_summary(spark, root, _m(spark, root))


def sql(body: str, *extra_names: str, extra: dict | None = None) -> str:
    return B.with_bindings(body, "b3_meetings", *extra_names, extra={**M_SQL, **(extra or {})})


# ------------------------------------------------------------------- KPIs
@register("agg1_kpis", sql(f"""
SELECT count(*) AS total_meetings, {Q.round_fixed('avg(sentiment_score)', 2)} AS avg_sentiment,
       {Q.round_fixed('sum(duration) / CAST(60.0 AS DOUBLE)', 1)} AS total_hours FROM m"""))
def agg1_kpis(spark, root):
    """AGG1: meeting count, average score, total hours."""
    return A.kpis(_m(spark, root))


@register("agg2_call_type_counts", sql("SELECT call_type, count(*) AS count FROM m GROUP BY call_type"))
def agg2_call_type_counts(spark, root):
    """AGG2: meetings per call type."""
    return A.count_by(_m(spark, root), "call_type")


@register("agg3_sentiment_counts", sql(
    "SELECT overall_sentiment, count(*) AS count FROM m GROUP BY overall_sentiment"))
def agg3_sentiment_counts(spark, root):
    """AGG3: meetings per overall sentiment."""
    return A.count_by(_m(spark, root), "overall_sentiment")


@register("agg4_call_type_share", sql(f"""
SELECT call_type, count, {Q.round_fixed('CAST(count AS DOUBLE) / CAST(sum(count) OVER () AS DOUBLE) * 100.0', 0)} AS pct
FROM (SELECT call_type, count(*) AS count FROM m GROUP BY call_type)"""))
def agg4_call_type_share(spark, root):
    """AGG4 (WIN5): whole-percent share per call type."""
    return A.share_by(_m(spark, root), "call_type")


@register("agg4_call_type_share_tenths", sql(f"""
SELECT call_type, count, {Q.round_fixed('CAST(count AS DOUBLE) / CAST(sum(count) OVER () AS DOUBLE) * 100.0', 1)} AS pct
FROM (SELECT call_type, count(*) AS count FROM m GROUP BY call_type)"""))
def agg4_call_type_share_tenths(spark, root):
    """AGG4 (WIN5): share per call type to a tenth of a percent."""
    return A.share_by(_m(spark, root), "call_type", digits=1)


# ---------------------------------------------------------- account risk
ACCOUNT_SQL = f"""
SELECT customer,
       CASE WHEN avg(sentiment_score) < 2.6 OR count(*) FILTER (WHERE call_type = 'Support') >= 3 THEN 'High'
            WHEN avg(sentiment_score) < 3.4 OR count(*) FILTER (WHERE call_type = 'Support') >= 1 THEN 'Medium'
            ELSE 'Low' END AS risk,
       {Q.round_fixed('avg(sentiment_score)', 2)} AS avg_sentiment,
       count(*) FILTER (WHERE call_type = 'Support') AS support_calls,
       count(*) AS total_calls
FROM (SELECT {Q.first_match('title', B.B3_ACCOUNTS)} AS customer, sentiment_score, call_type FROM m)
WHERE customer IS NOT NULL GROUP BY customer"""


@register("alg4_account_risk", sql(ACCOUNT_SQL))
def alg4_account_risk(spark, root):
    """ALG4 (AGG5): risk level, average score and support calls per account
    named in meeting titles."""
    return A.account_stats(_m(spark, root), B.b3_dictionaries())


@register("srt2_account_risk_top", sql("""
SELECT * FROM accounts
ORDER BY CASE risk WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 WHEN 'Low' THEN 2 ELSE 3 END, avg_sentiment, customer
LIMIT 12""", extra={"accounts": ACCOUNT_SQL}))
def srt2_account_risk_top(spark, root):
    """SRT2: the 12 riskiest accounts (High first, then lower averages)."""
    return A.account_risk_top(A.account_stats(_m(spark, root), B.b3_dictionaries()))


@register("fil13_account_filter", sql("""
SELECT * FROM accounts WHERE contains(lower(customer), 'th') AND risk = 'Medium'""",
                                      extra={"accounts": ACCOUNT_SQL}))
def fil13_account_filter(spark, root):
    """FIL13: accounts whose name contains 'th' with Medium risk."""
    return A.filter_accounts(A.account_stats(_m(spark, root), B.b3_dictionaries()), "TH", "Medium")


@register("srt8_account_sort", sql("SELECT * FROM accounts ORDER BY total_calls DESC, customer",
                                   extra={"accounts": ACCOUNT_SQL}))
def srt8_account_sort(spark, root):
    """SRT8: the account list sorted by a chosen key (total calls, descending)."""
    return A.sort_by(A.account_stats(_m(spark, root), B.b3_dictionaries()), "total_calls", False, "customer")


# --------------------------------------------------------------- timeline
TIMELINE_SQL = f"""
SELECT strftime(date, '%Y-%m-%d') AS date, {Q.round_fixed('avg_score', 2)} AS sentiment, count FROM (
  SELECT CAST(start_time AS DATE) AS date, avg(sentiment_score) AS avg_score, count(*) AS count
  FROM m GROUP BY 1 ORDER BY date DESC NULLS FIRST LIMIT 30)
ORDER BY date ASC NULLS LAST"""


@register("agg8_daily_timeline", sql(TIMELINE_SQL))
def agg8_daily_timeline(spark, root):
    """AGG8: average score and meetings per day, last 30 active days."""
    return A.daily_timeline(_m(spark, root))


# ----------------------------------------------------- score statistics
@register("agg15_score_summary", sql(f"""
SELECT call_type, count(sentiment_score) AS count, {Q.six('avg(sentiment_score)')} AS mean,
       {Q.six('stddev_samp(sentiment_score)')} AS std, min(sentiment_score) AS min,
       {Q.six('quantile_cont(sentiment_score, 0.25)')} AS q25, {Q.six('quantile_cont(sentiment_score, 0.5)')} AS q50,
       {Q.six('quantile_cont(sentiment_score, 0.75)')} AS q75, max(sentiment_score) AS max
FROM m WHERE sentiment_score IS NOT NULL GROUP BY call_type"""))
def agg15_score_summary(spark, root):
    """AGG15: describe() of the score per call type (exact quartiles)."""
    return A.score_summary(_m(spark, root))


@register("agg16_box_stats", sql(f"""
SELECT q.call_type, {Q.six('q.q25')} AS q25, {Q.six('q.q50')} AS q50, {Q.six('q.q75')} AS q75,
       {Q.six('q.q75 - q.q25')} AS iqr,
       min(v.sentiment_score) FILTER (WHERE v.sentiment_score >= q.q25 - 1.5 * (q.q75 - q.q25) AND v.sentiment_score <= q.q75 + 1.5 * (q.q75 - q.q25)) AS whisker_low,
       max(v.sentiment_score) FILTER (WHERE v.sentiment_score >= q.q25 - 1.5 * (q.q75 - q.q25) AND v.sentiment_score <= q.q75 + 1.5 * (q.q75 - q.q25)) AS whisker_high,
       count(*) FILTER (WHERE NOT (v.sentiment_score >= q.q25 - 1.5 * (q.q75 - q.q25) AND v.sentiment_score <= q.q75 + 1.5 * (q.q75 - q.q25))) AS outliers
FROM m v JOIN (SELECT call_type, quantile_cont(sentiment_score, 0.25) AS q25, quantile_cont(sentiment_score, 0.5) AS q50,
                      quantile_cont(sentiment_score, 0.75) AS q75
               FROM m WHERE sentiment_score IS NOT NULL GROUP BY call_type) q ON q.call_type = v.call_type
WHERE v.sentiment_score IS NOT NULL
GROUP BY q.call_type, q.q25, q.q50, q.q75"""))
def agg16_box_stats(spark, root):
    """AGG16: box-plot numbers (quartiles, whiskers, outliers) per call type."""
    return A.box_stats(_m(spark, root))


@register("agg24_duration_histogram", sql("""
SELECT bin, call_type, count(*) AS count, lo + CAST(bin AS DOUBLE) * w AS bin_start,
       lo + CAST(bin + 1 AS DOUBLE) * w AS bin_end
FROM (SELECT v.call_type, r.lo, r.w,
             CAST(CASE WHEN r.w > 0 THEN least(floor((v.x - r.lo) / r.w), 14) ELSE 0 END AS INTEGER) AS bin
      FROM (SELECT duration / CAST(60.0 AS DOUBLE) AS x, call_type FROM m WHERE duration IS NOT NULL) v,
           (SELECT min(duration / CAST(60.0 AS DOUBLE)) AS lo,
                   (max(duration / CAST(60.0 AS DOUBLE)) - min(duration / CAST(60.0 AS DOUBLE))) / CAST(15.0 AS DOUBLE) AS w
            FROM m WHERE duration IS NOT NULL) r)
GROUP BY bin, call_type, lo, w"""))
def agg24_duration_histogram(spark, root):
    """AGG24 (ENR19): 15-bin histogram of duration/60 stacked by call type."""
    return A.duration_histogram(_m(spark, root))


# ------------------------------------------------------- list filters
LIST_FILTER = ("(title ILIKE '%the%' OR summary ILIKE '%the%') AND call_type = 'External' "
               "AND overall_sentiment = 'positive' AND title ILIKE '%and%'")
LIST_ARGS = dict(search="the", call_type="External", sentiment="positive", customer="and")


@register("fil5_meeting_filters", B.with_bindings(f"SELECT * FROM b3_summaries WHERE {LIST_FILTER}", "b3_summaries"))
def fil5_meeting_filters(spark, root):
    """FIL1-FIL5: search, call type, sentiment and customer filters combined."""
    return _listed(spark, root).filter(FL.meeting_filters(**LIST_ARGS))


@register("fil1_search_filter", B.with_bindings("SELECT * FROM b3_summaries WHERE title ILIKE '%th_t%' OR summary ILIKE '%th_t%'", "b3_summaries"))
def fil1_search_filter(spark, root):
    """FIL1: case-insensitive title/summary search ('_' stays a wildcard)."""
    return _listed(spark, root).filter(FL.meeting_filters(search="TH_T"))


@register("srt1_meeting_page", B.with_bindings("""
SELECT * FROM b3_summaries WHERE title ILIKE '%the%' OR summary ILIKE '%the%'
ORDER BY start_time DESC, meeting_id LIMIT 12 OFFSET 12""", "b3_summaries"))
def srt1_meeting_page(spark, root):
    """SRT1: second page of 12 meetings matching a search, newest first."""
    return FL.list_meetings(_listed(spark, root), limit=12, offset=FL.page_offset(2), search="the")


@register("agg28_filtered_total", B.with_bindings("""
SELECT count(*) AS total FROM b3_summaries WHERE title ILIKE '%the%' OR summary ILIKE '%the%'""", "b3_summaries"))
def agg28_filtered_total(spark, root):
    """AGG28: total of the filtered list before paging."""
    return FL.count_meetings(_listed(spark, root), search="the")


@register("fil6_non_internal", B.with_bindings("SELECT * FROM b3_summaries WHERE call_type != 'Internal'", "b3_summaries"))
def fil6_non_internal(spark, root):
    """FIL6: meetings that are not internal calls (NULL excluded)."""
    return _listed(spark, root).filter(F.col("call_type") != "Internal")


@register("fil10_point_lookup", B.with_bindings("SELECT * FROM b3_summaries WHERE meeting_id = 42", "b3_summaries"))
def fil10_point_lookup(spark, root):
    """FIL10: one meeting by key."""
    return FL.lookup(_listed(spark, root), "meeting_id", 42)


@register("fil11_date_drilldown", B.with_bindings("SELECT * FROM b3_summaries WHERE CAST(start_time AS DATE) = DATE '2024-01-01'", "b3_summaries"))
def fil11_date_drilldown(spark, root):
    """FIL11: meetings starting on a given day."""
    return FL.on_date(_listed(spark, root), "2024-01-01")


# ------------------------------------------------------- enrichment
def _invitees(spark, root):
    conv = read_table(spark, root, "conversations")
    return conv.groupBy(F.col("conv_id").alias("meeting_id")).agg(F.countDistinct("role").alias("invitee_count"))


INVITEES_SQL = {"inv": "SELECT conv_id AS meeting_id, count(DISTINCT role) AS invitee_count FROM conversations GROUP BY conv_id"}
CALL_TYPE_SQL = (f"CASE WHEN {Q.any_contains('lower(m.title)', B.B3_SUPPORT_KEYWORDS)} THEN 'Support' "
                 f"WHEN {Q.any_contains('lower(m.title)', B.B3_INTERNAL_KEYWORDS)} THEN 'Internal' "
                 "WHEN coalesce(i.invitee_count, 0) <= 1 THEN 'Internal' ELSE 'External' END")


@register("enr3_call_type", sql(f"""
SELECT m.meeting_id, {CALL_TYPE_SQL} AS derived_call_type
FROM m LEFT JOIN inv i ON i.meeting_id = m.meeting_id""", extra=INVITEES_SQL))
def enr3_call_type(spark, root):
    """ENR3: call type from title keywords and the number of invitees."""
    m = _m(spark, root).join(_invitees(spark, root), "meeting_id", "left")
    return m.select("meeting_id", C.call_type("title", "invitee_count", B.b3_dictionaries()).alias("derived_call_type"))


def _addresses():
    """Before the usable address one that is none and one of an ignored domain."""
    return F.array(F.lit("no address"), F.lit(f"a@{B.B9_IGNORED_DOMAINS[0]}.example"), F.col("email"))


def _title_case_sql(x: str) -> str:
    # str.title() for labels made of letters, digits and '-' (DuckDB side)
    return (f"(SELECT string_agg(CASE WHEN i = 1 OR NOT regexp_matches(substr(lower({x}), i - 1, 1), '^\\p{{L}}$') "
            f"THEN upper(substr(lower({x}), i, 1)) ELSE substr(lower({x}), i, 1) END, '' ORDER BY i) "
            f"FROM range(1, length({x}) + 1) t(i))")


ACCOUNT_RESOLVE_SQL = f"""
SELECT m.meeting_id, coalesce({Q.first_match('m.title', B.B3_ACCOUNTS)}, dom.account, 'Unknown Customer') AS account
FROM m LEFT JOIN (
  SELECT meeting_id, CASE WHEN lbl IS NULL THEN NULL ELSE coalesce({_title_case_sql('lbl')}, '') END AS account
  FROM (SELECT meeting_id, split_part(split_part(email, '@', 2), '.', 1) AS lbl FROM b9_addresses
        WHERE contains(email, '@')
          AND split_part(split_part(email, '@', 2), '.', 1) NOT IN ({', '.join(Q.lit(x) for x in B.B9_IGNORED_DOMAINS)}))
) dom ON dom.meeting_id = m.meeting_id"""


@register("enr6_resolve_account", sql(ACCOUNT_RESOLVE_SQL, "b9_addresses"))
def enr6_resolve_account(spark, root):
    """ENR4-ENR6: account from the title dictionary, else the mail domain,
    else 'Unknown Customer'."""
    d = B.b3_dictionaries().with_(ignored_domains=B.B9_IGNORED_DOMAINS)
    mails = B.b9_addresses(spark, root).select("meeting_id", _addresses().alias("all_emails"))
    m = _m(spark, root).join(mails, "meeting_id", "left")
    return m.select("meeting_id", C.resolve_account("title", F.coalesce("all_emails", F.array().cast("array<string>")), d).alias("account"))


@register("enr4_account_by_title", sql(f"""
SELECT meeting_id, {Q.first_match('title', B.B3_ACCOUNTS)} AS account FROM m"""))
def enr4_account_by_title(spark, root):
    """ENR4: first dictionary account (priority order) named in the title."""
    return _m(spark, root).select("meeting_id", C.account_from_title("title", B.b3_dictionaries()).alias("account"))


@register("enr21_sentiment_band", sql("""
SELECT meeting_id, sentiment_score, CASE WHEN sentiment_score >= 4.0 THEN 'Excellent' WHEN sentiment_score >= 3.2 THEN 'Positive'
       WHEN sentiment_score >= 2.8 THEN 'Mixed' ELSE 'Negative' END AS band FROM m"""))
def enr21_sentiment_band(spark, root):
    """ENR21: display band of the meeting score."""
    return _m(spark, root).select("meeting_id", "sentiment_score", C.sentiment_band("sentiment_score").alias("band"))


@register("enr22_projection", sql("""
SELECT meeting_id, title, start_time, end_time, duration, duration / CAST(60.0 AS DOUBLE) AS duration_hours,
       overall_sentiment, sentiment_score, call_type FROM m"""))
def enr22_projection(spark, root):
    """ENR22 + ENR19: named projection with the duration in hours."""
    return A.hours(_m(spark, root)).select("meeting_id", "title", "start_time", "end_time", "duration", "duration_hours",
                                           "overall_sentiment", "sentiment_score", "call_type")


# --------------------------------------------------- addresses (binding B9)
DOMAIN_ACCOUNT_SQL = f"""
SELECT a.meeting_id, CASE WHEN d.lbl IS NULL THEN NULL ELSE coalesce({_title_case_sql('d.lbl')}, '') END AS account
FROM b9_addresses a LEFT JOIN (
  SELECT meeting_id, split_part(split_part(email, '@', 2), '.', 1) AS lbl FROM b9_addresses
  WHERE contains(email, '@')
    AND split_part(split_part(email, '@', 2), '.', 1) NOT IN ({', '.join(Q.lit(x) for x in B.B9_IGNORED_DOMAINS)})) d
ON d.meeting_id = a.meeting_id"""


@register("enr5_account_by_domain", B.with_bindings(DOMAIN_ACCOUNT_SQL, "b9_addresses"))
def enr5_account_by_domain(spark, root):
    """ENR5: account from the first usable mail domain (title-cased label)."""
    d = B.b9_dictionaries()
    a = B.b9_addresses(spark, root)
    return a.select("meeting_id", C.account_from_emails(_addresses(), d).alias("account"))


@register("enr20_host_display_name", B.with_bindings("""
SELECT meeting_id, email, array_to_string(list_transform(string_split(split_part(email, '@', 1), '.'),
                                                         lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS host_name
FROM b9_addresses""", "b9_addresses"))
def enr20_host_display_name(spark, root):
    """ENR20: display name of the host address."""
    return B.b9_addresses(spark, root).select("meeting_id", "email", X.display_name("email").alias("host_name"))
