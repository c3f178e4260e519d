"""Incremental ingestion: two waves of bundle files, one folder completed in
the second wave; the result equals the batch job on the final folder."""

from __future__ import annotations

import os

import reference_model
from bundle_factory import bundle, make_bundles, write

from colloquy.streaming import bundle_stream as BS


def plain(rows):
    """Rows in order; a NaN equals itself."""
    return sorted((tuple("NaN" if x != x else x for x in r) for r in rows), key=repr)


def rows(df):
    return plain(df.collect())


def test_two_waves_match_batch_model(spark, tmp_path):
    root, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    os.makedirs(root)
    late = bundle("L01", "Late Summit Trust call", turns=[])
    # wave 1: one complete folder, one missing its transcript
    write(root, "w1_ok", bundle("W1", "Helix Data sync"))
    write(root, "w1_late", late, skip=("transcript.json",))
    q = BS.start(spark, root, out, ck)
    q.awaitTermination(120)
    first = {r.folder: r.reason for r in BS.read_status(spark, out).collect()}
    assert first == {"w1_ok": None, "w1_late": "missing"}
    # wave 2: the missing file arrives, plus the hand-made set
    write(root, "w1_late", {"transcript.json": late["transcript.json"]})
    make_bundles(root)
    q = BS.start(spark, root, out, ck)
    q.awaitTermination(180)
    tables = BS.read_tables(spark, out)
    expected, errors = reference_model.run(root)
    for name in ("meetings", "transcript_segments", "action_items", "topics", "entities", "graph_edges"):
        assert rows(tables[name]) == plain(expected[name]), name
    status = {r.folder: r.reason for r in BS.read_status(spark, out).collect()}
    assert status["w1_late"] is None
    # a folder without any file has not arrived for a stream of files
    assert {f for f, r in status.items() if r} == {e[0] for e in errors} - {"m40_empty_folder"}


def test_an_epoch_run_again_keeps_its_meetings(spark, tmp_path, monkeypatch):
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    make_bundles(root)
    files = spark.read.format("binaryFile").load(os.path.join(root, "*", "*.json")).select("path")
    BS.process_batch(spark, files, 0, out)
    once = {n: rows(t) for n, t in BS.read_tables(spark, out).items()}
    status = rows(BS.read_status(spark, out))
    assert once["meetings"] and status
    BS.process_batch(spark, files, 0, out)
    assert {n: rows(t) for n, t in BS.read_tables(spark, out).items()} == once
    assert rows(BS.read_status(spark, out)) == status
