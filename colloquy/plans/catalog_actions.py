"""Queries over action items (binding B8, with B3 meetings): parsing,
workload, deadlines, the action centre and status updates."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import dictionaries as DICT
from ..functions import text as X
from ..operators import actions as ACT
from ..operators import analytics as A
from ..operators import enrich as E
from ..operators import filters as FL
from ..operators import stored as ST
from ..session import checkpoint_dir
from ..sources import bindings as B
from . import sqltext as Q
from .registry import register


def _deadline_sql(expr: str) -> str:
    whens = []
    for pattern, label in DICT.DEADLINE_PATTERNS:
        cond = f"regexp_matches({expr}, {Q.lit(pattern)}, 'i')"
        if "{1}" in label:
            before, after = label.split("{1}", 1)
            value = f"concat({Q.lit(before)}, regexp_extract({expr}, {Q.lit(pattern)}, 1, 'i'), {Q.lit(after)})"
        else:
            value = Q.lit(label)
        whens.append(f"WHEN {cond} THEN {value}")
    return f"(CASE {' '.join(whens)} ELSE {Q.lit(DICT.NO_DEADLINE)} END)"


def _strip(expr: str) -> str:
    blank = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
    return f"regexp_replace({expr}, '^{blank}|{blank}$', '', 'g')"


ITEMS_SQL = f"""
SELECT id, meeting_id, task, owner, {_deadline_sql('task')} AS deadline, 'Open' AS status FROM (
  SELECT concat(meeting_id, '_ai_', pos) AS id, meeting_id,
         CASE WHEN contains(item, ':') THEN {_strip("substr(item, strpos(item, ':') + 1)")} ELSE {_strip('item')} END AS task,
         CASE WHEN contains(item, ':') THEN {_strip("substr(item, 1, strpos(item, ':') - 1)")} ELSE 'Unassigned' END AS owner
  FROM b8_items)"""
UPDATES_SQL = """
SELECT id, 'Closed' AS status, 1 AS seq FROM items WHERE deadline = 'Friday'
UNION ALL SELECT id, 'Blocked', 2 FROM items WHERE owner = 'user'
UNION ALL SELECT id, 'Bogus', 3 FROM items WHERE owner = 'system'
UNION ALL SELECT concat(id, '#missing'), 'Open', 4 FROM items WHERE deadline = 'N/A'"""
UPDATED_SQL = """
SELECT i.id, i.meeting_id, i.task, i.owner, i.deadline, coalesce(l.new_status, i.status) AS status
FROM items i LEFT JOIN (
  SELECT id, arg_max(status, seq) AS new_status FROM updates
  WHERE status IN ('Open', 'Closed', 'Blocked') AND id IN (SELECT id FROM items) GROUP BY id) l ON l.id = i.id"""
CTES = {"items": ITEMS_SQL, "updates": UPDATES_SQL, "updated": UPDATED_SQL}


def sql(body: str, *names: str) -> str:
    return B.with_bindings(body, "b8_items", *names, extra=CTES)


def _items(spark, root):
    return E.action_items(B.b8_items(spark, root), "meeting_id", "pos", "item")


def _updates(items):
    return (items.filter(F.col("deadline") == "Friday").select("id", F.lit("Closed").alias("status"), F.lit(1).alias("seq"))
            .unionByName(items.filter(F.col("owner") == "user").select("id", F.lit("Blocked").alias("status"), F.lit(2).alias("seq")))
            .unionByName(items.filter(F.col("owner") == "system").select("id", F.lit("Bogus").alias("status"), F.lit(3).alias("seq")))
            .unionByName(items.filter(F.col("deadline") == DICT.NO_DEADLINE)
                         .select(F.concat("id", F.lit("#missing")).alias("id"), F.lit("Open").alias("status"), F.lit(4).alias("seq"))))


def _updated(spark, root):
    items = _items(spark, root)
    return ACT.apply_status_updates(items, _updates(items))


@register("enr7_10_action_items", sql("SELECT * FROM items"))
def enr7_10_action_items(spark, root):
    """ENR7-ENR10 (ENR9): owner, task, deadline label and status per item."""
    return _items(spark, root)


@register("enr18_action_labels", sql("SELECT id, concat(substr(task, 1, 40), '...') AS label FROM items"))
def enr18_action_labels(spark, root):
    """ENR18: graph label of an action item (40 characters + '...')."""
    return _items(spark, root).select("id", X.label_with_ellipsis("task", DICT.ACTION_LABEL_CHARS).alias("label"))


@register("agg22_owner_workload", sql("""
SELECT owner, count(*) AS count FROM items GROUP BY owner ORDER BY count DESC, owner LIMIT 10"""))
def agg22_owner_workload(spark, root):
    """AGG22: items per owner, top 10."""
    return A.owner_workload(_items(spark, root))


@register("agg23_deadline_distribution", sql("SELECT deadline, count(*) AS count FROM items GROUP BY deadline"))
def agg23_deadline_distribution(spark, root):
    """AGG23: items per deadline label."""
    return A.count_by(_items(spark, root), "deadline")


@register("mut1_apply_updates", sql("SELECT * FROM updated"))
def mut1_apply_updates(spark, root):
    """MUT1: a batch of status updates applied (latest valid update wins)."""
    return _updated(spark, root)[0]


@register("mut1_stored_updates", sql("SELECT * FROM updated"))
def mut1_stored_updates(spark, root):
    """MUT1, SNK1: action items stored, the same updates merged into the
    stored table and read back."""
    store = f"{checkpoint_dir(spark)}/store-{uuid.uuid4()}"
    ST.refresh({"action_items": _items(spark, root)}, store, {"action_items": ("id", 16)})
    ST.merge(spark, store, "action_items", _updates(_items(spark, root)), ACT.apply_status_updates)
    return ST.load(spark, store)["action_items"]


@register("snk1_full_refresh", sql("SELECT id, deadline FROM items"))
def snk1_full_refresh(spark, root):
    """SNK1: a stored table replaced by a full refresh."""
    store = f"{checkpoint_dir(spark)}/store-{uuid.uuid4()}"
    items = _items(spark, root)
    ST.refresh({"items": items.select("id", F.lit("old").alias("deadline"))}, store)
    ST.refresh({"items": items.select("id", "deadline")}, store)
    return ST.load(spark, store)["items"]


@register("mut1_rejected_updates", sql("""
SELECT u.id, u.status, u.seq, CASE WHEN u.status NOT IN ('Open', 'Closed', 'Blocked') OR u.status IS NULL THEN 'invalid status'
                                   ELSE 'not found' END AS reason
FROM updates u WHERE u.status NOT IN ('Open', 'Closed', 'Blocked') OR u.status IS NULL OR u.id NOT IN (SELECT id FROM items)"""))
def mut1_rejected_updates(spark, root):
    """MUT1: updates rejected for an invalid status or an unknown id."""
    return _updated(spark, root)[1]


@register("mut2_toggle", sql("""
SELECT *, CASE WHEN status = 'Closed' THEN 'Open' ELSE 'Closed' END AS next_status FROM updated"""))
def mut2_toggle(spark, root):
    """MUT2: the status each item would toggle to."""
    return ACT.toggled(_updated(spark, root)[0])


@register("fil14_items_by_status", sql("SELECT * FROM updated WHERE status = 'Closed'"))
def fil14_items_by_status(spark, root):
    """FIL14: items with one status."""
    return FL.by_status(_updated(spark, root)[0], "Closed")


@register("fil16_pending_count", sql("SELECT count(*) FILTER (WHERE status != 'Closed') AS pending FROM updated"))
def fil16_pending_count(spark, root):
    """FIL16: number of items not Closed."""
    return FL.pending_count(_updated(spark, root)[0])


@register("alg15_action_centre", sql("""
SELECT u.id, u.meeting_id, m.title AS meeting_title, u.task, u.owner, u.deadline, u.status
FROM updated u JOIN b3_meetings m ON u.meeting_id = m.meeting_id
WHERE u.status = 'Blocked' ORDER BY m.start_time DESC, u.id""", "b3_meetings"))
def alg15_action_centre(spark, root):
    """ALG15 (JOI3, SRT9): blocked items with meeting titles, newest meeting
    first."""
    return ACT.action_centre(_updated(spark, root)[0], B.b3_meetings(spark, root), status="Blocked")
