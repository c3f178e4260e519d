"""Stored tables: one state at a time, and merges that leave other buckets alone."""

from __future__ import annotations

import os
import threading

import pytest

from colloquy.operators import actions as ACT
from colloquy.operators import stored as ST


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_readers_never_see_a_gap_or_a_mix(spark, tmp_path):
    root = str(tmp_path)
    put = lambda k: ST.refresh({n: frame(spark, [(k, i) for i in range(5)], "state int, i int") for n in ("a", "b")}, root)
    put(0)
    seen, wrong, done = [], [], threading.Event()

    def reader():
        while not done.is_set():
            try:
                t = ST.load(spark, root)
                states = {n: {r.state for r in df.collect()} for n, df in t.items()}
            except Exception as e:  # noqa: BLE001
                wrong.append(repr(e))
                return
            seen.append(states)
            if len(states) != 2 or len(set.union(*states.values())) != 1:
                wrong.append(states)

    thread = threading.Thread(target=reader)
    thread.start()
    for k in range(1, 6):
        put(k)
    done.set()
    thread.join(60)
    assert not wrong and seen
    assert {r.state for r in ST.load(spark, root)["b"].collect()} == {5}
    assert ST.vacuum(spark, root) == 10
    assert ST.load(spark, root)["a"].count() == 5


def test_two_writers_do_not_overwrite(spark, tmp_path):
    root = str(tmp_path)
    ST.refresh({"a": frame(spark, [(1,)], "x int")}, root)
    with pytest.raises(ST.Conflict):
        ST._commit(spark, root, 1, {})
    assert ST.load(spark, root)["a"].count() == 1


def files(root):
    return {os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


def test_status_updates_change_the_stored_table(spark, tmp_path):
    root = str(tmp_path)
    schema = "id string, meeting_id string, task string, owner string, deadline string, status string"
    items = [(f"M_ai_{i}", "M", f"t{i}", "o", "N/A", "Open") for i in range(200)]
    ST.refresh({"action_items": frame(spark, items, schema), "other": frame(spark, [(1,)], "x int")}, root, {"action_items": ("id", 16)})
    before, entry = files(root), ST.manifest(spark, root)["tables"]["action_items"]
    updates = frame(spark, [("M_ai_3", "Closed", 1), ("M_ai_3", "Blocked", 2), ("M_ai_9", "Wrong", 3), ("nobody", "Open", 4)],
                    "id string, status string, seq int")
    rejects = ST.merge(spark, root, "action_items", updates, ACT.apply_status_updates)
    assert {(r.id, r.reason) for r in rejects.collect()} == {("M_ai_9", "invalid status"), ("nobody", "not found")}
    got = {r.id: r.status for r in ST.load(spark, root)["action_items"].collect()}
    assert got == {i[0]: "Blocked" if i[0] == "M_ai_3" else "Open" for i in items}
    after = ST.manifest(spark, root)["tables"]["action_items"]
    changed = {b for b in after["folders"] if after["folders"][b] != entry["folders"].get(b)}
    assert 1 <= len(changed) <= 3 and before <= files(root)
    assert ST.vacuum(spark, root) >= 1
    assert {r.id: r.status for r in ST.load(spark, root)["action_items"].collect()} == got
