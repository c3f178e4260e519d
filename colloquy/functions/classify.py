"""Labelling rules expressed as Column CASE chains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dictionaries as DICT
from ..dictionaries import DEFAULT, Dictionaries
from .text import col_, contains_any, domain_label, domain_part, first_match, local_part, python_title, strip_ws


def fixed_round(c: str | Column, digits: int) -> Column:
    """Round half-up on the decimal value (to 6 places first), returned as a
    double. Rounding on decimals instead of binary doubles makes
    ``round(2.675, 2)`` 2.68 on every engine."""
    return F.round(col_(c).cast("decimal(38,6)"), digits).cast("double")


def six_places(c: str | Column) -> Column:
    """A double reported to 6 decimal places (for statistics whose last binary
    digits depend on summation order)."""
    return col_(c).cast("decimal(38,6)").cast("double")


def call_type(title: str | Column, invitee_count: str | Column, d: Dictionaries = DEFAULT) -> Column:
    """Support if the title holds a support keyword; Internal if it holds an
    internal keyword or there is at most one invitee (NULL counts as none);
    else External. Pass ``F.size(invitees)`` for an invitee array."""
    t = F.lower(col_(title))
    few_invitees = F.coalesce(col_(invitee_count), F.lit(0)) <= 1
    return (F.when(contains_any(t, d.support_keywords), F.lit("Support"))
            .when(contains_any(t, d.internal_keywords), F.lit("Internal"))
            .when(few_invitees, F.lit("Internal"))
            .otherwise(F.lit("External")))


def account_from_title(title: str | Column, d: Dictionaries = DEFAULT) -> Column:
    """First known customer (in priority order) named inside the title."""
    return first_match(title, d.customers)


def account_from_emails(emails: str | Column, d: Dictionaries = DEFAULT) -> Column:
    """Title-cased first domain label of the first address that has an '@'
    and whose label is not ignored. (The reference also swaps 'corp'/'inc'
    for capitalised forms, which title-casing then undoes.)"""
    ignored = F.array(*[F.lit(x) for x in d.ignored_domains]) if d.ignored_domains else F.array().cast("array<string>")
    usable = F.filter(col_(emails), lambda e: e.contains("@") & ~F.array_contains(ignored, domain_label(e)))
    return python_title(domain_label(F.get(usable, 0)))


def resolve_account(title: str | Column, emails: str | Column, d: Dictionaries = DEFAULT) -> Column:
    return F.coalesce(account_from_title(title, d), account_from_emails(emails, d),
                      F.lit(DICT.UNKNOWN_CUSTOMER))


def split_owner_task(item: str | Column) -> tuple[Column, Column]:
    """Owner and task of an action item, split at the first colon; without a
    colon the owner is 'Unassigned' and the task is the whole item."""
    parts = F.split(col_(item), ":", 2)
    has_colon = F.size(parts) == 2
    owner = F.when(has_colon, strip_ws(F.get(parts, 0))).otherwise(F.lit(DICT.UNASSIGNED))
    task = F.when(has_colon, strip_ws(F.get(parts, 1))).otherwise(strip_ws(col_(item)))
    return owner, task


def deadline_label(task: str | Column, d: Dictionaries = DEFAULT) -> Column:
    """Label of the first deadline pattern found in the task (case-insensitive);
    '{1}' in a label is replaced by the pattern's first group."""
    out = None
    for pattern, label in d.deadline_patterns:
        rx = "(?iU)" + pattern
        cond = col_(task).rlike(rx)
        if "{1}" in label:
            before, after = label.split("{1}", 1)
            value = F.concat(F.lit(before), F.regexp_extract(col_(task), rx, 1), F.lit(after))
        else:
            value = F.lit(label)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    base = F.lit(DICT.NO_DEADLINE)
    return out.otherwise(base) if out is not None else base


def speaker_role(speaker: str | Column, emails: str | Column, host: str | Column,
                 call_type_col: str | Column, d: Dictionaries = DEFAULT) -> Column:
    """Role of a transcript speaker.

    An address belongs to the speaker when its local part (dots as spaces) is
    inside the lower-cased name, or the name is inside the local part. A staff
    speaker owns an address containing the host's domain, or has a staff hint
    in the name; staff map to Support Agent / Engineer / Account Manager by
    call type, everyone else is Engineer on internal calls and Customer
    otherwise.
    """
    s = F.lower(F.coalesce(col_(speaker), F.lit("")))
    host_c = F.coalesce(col_(host), F.lit(""))
    h_domain = F.when(host_c.contains("@"), F.coalesce(domain_part(host_c), F.lit(""))).otherwise(F.lit(""))
    emails_c = F.coalesce(col_(emails), F.array().cast("array<string>"))

    def owns(e: Column) -> Column:
        lp = F.lower(local_part(e))
        return s.contains(F.regexp_replace(lp, r"\.", " ")) | lp.contains(s)

    staff_by_mail = F.exists(emails_c, lambda e: owns(e) & e.contains(h_domain))
    staff_by_name = contains_any(s, d.staff_hints)
    ct = col_(call_type_col)
    staff_role = (F.when(ct == "Support", F.lit("Support Agent"))
                  .when(ct == "Internal", F.lit("Engineer"))
                  .otherwise(F.lit("Account Manager")))
    return (F.when(staff_by_mail | staff_by_name, staff_role)
            .when(ct == "Internal", F.lit("Engineer"))
            .otherwise(F.lit("Customer")))


def sentiment_band(score: str | Column) -> Column:
    out = None
    for floor, label in DICT.SENTIMENT_BANDS:
        cond = col_(score) >= floor
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(DICT.SENTIMENT_BAND_FLOOR))


def risk_tier(score: str | Column) -> Column:
    """Right-closed bins (0,30] Low, (30,60] Medium, (60,100] High; anything
    else (0, negatives, above 100, NULL) stays NULL."""
    out = None
    for lo, hi, label in DICT.RISK_TIERS:
        cond = (col_(score) > lo) & (col_(score) <= hi)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


def account_risk(avg_score: str | Column, support_calls: str | Column) -> Column:
    hi_avg, hi_sup = DICT.ACCOUNT_RISK_HIGH
    md_avg, md_sup = DICT.ACCOUNT_RISK_MEDIUM
    a, s = col_(avg_score), col_(support_calls)
    return (F.when((a < hi_avg) | (s >= hi_sup), F.lit("High"))
            .when((a < md_avg) | (s >= md_sup), F.lit("Medium"))
            .otherwise(F.lit("Low")))


def ordered_rank(c: str | Column, order: tuple[str, ...]) -> Column:
    """Position of a value in a fixed order; unknown values rank last."""
    out = None
    for i, v in enumerate(order):
        cond = col_(c) == v
        out = F.when(cond, F.lit(i)) if out is None else out.when(cond, F.lit(i))
    return out.otherwise(F.lit(len(order)))


def route_question(question: str | Column, d: Dictionaries = DEFAULT) -> Column:
    """Route of a question: the first route with a keyword inside it."""
    q = F.lower(col_(question))
    out = None
    for route, words in d.routes:
        cond = contains_any(q, words)
        out = F.when(cond, F.lit(route)) if out is None else out.when(cond, F.lit(route))
    return out.otherwise(F.lit(DICT.DEFAULT_ROUTE))


def toggle_status(status: str | Column) -> Column:
    """Closed -> Open, anything else -> Closed."""
    return F.when(col_(status) == "Closed", F.lit("Open")).otherwise(F.lit("Closed"))
