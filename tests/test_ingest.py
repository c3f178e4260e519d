"""The ingestion job on hand-made bundles against the plain-Python model."""

from __future__ import annotations

import json
import math
import os
import random

import pytest

from bundle_factory import ALL, bundle, turn, write
from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.operators import sinks as SK
from colloquy.plans import ingest as ING
from colloquy.sources import bundles as BN
from colloquy.sources import json_pull


def norm(rows):
    def v(x):
        if isinstance(x, float) and math.isnan(x):
            return None
        return x
    return sorted((tuple(v(x) for x in r) for r in rows), key=repr)


TABLES = ["meetings", "transcript_segments", "action_items", "topics", "key_moments", "entities",
          "graph_nodes", "graph_edges"]


@pytest.mark.parametrize("table", TABLES)
def test_table_matches_model(ingested, table):
    res, expected, _, _ = ingested
    got = [tuple(r) for r in res.tables[table].collect()]
    assert norm(got) == norm(expected[table])


def test_rejects_match_model(ingested):
    res, _, errors, _ = ingested
    got = sorted((r.folder, r.reason, r.detail) for r in res.rejects.collect())
    assert got == sorted(errors)
    rep = res.report.first()
    assert rep.rejected == len(errors)
    from colloquy.sources.bundles import first_rejects
    shown = [r.detail for r in first_rejects(res.status).collect()]
    assert shown == [d for _, _, d in sorted(errors)][:5]


def test_written_tables_reload(spark, ingested):
    _, _, _, out = ingested
    tables = ING.load_tables(spark, out)
    counts = {r.table: r.rows for r in SK.row_counts(tables).collect()}
    assert counts["meetings"] == tables["meetings"].count() > 0
    assert os.path.isdir(os.path.join(out, "data"))


def test_keys_unique_and_edges_reference_nodes(ingested):
    res, _, _, _ = ingested
    for name, keys in [("meetings", ["meeting_id"]), ("transcript_segments", ["id"]), ("graph_nodes", ["id"]),
                       ("graph_edges", ["source", "target", "relation"])]:
        assert SK.key_violations(res.tables[name], keys).count() == 0
    # speaker-meta names that never speak give dangling DISCUSSES_TOPIC sources
    nodes = {r.id for r in res.tables["graph_nodes"].collect()}
    dangling = {r.source for r in res.tables["graph_edges"].collect() if r.source not in nodes}
    assert "Silent Observer" in dangling


def test_duplicate_meeting_id_fails(spark, tmp_path):
    root = tmp_path / "b"
    write(str(root), "a", bundle("DUP", "one"))
    write(str(root), "b", bundle("DUP", "two"))
    with pytest.raises(SK.KeyViolation):
        ING.ingest(spark, str(root), str(tmp_path / "out"))


# ------------------------------------------------------- JSON of any length
VALUES = st.recursive(
    st.none() | st.booleans() | st.integers() | st.floats() | st.text(max_size=12),
    lambda v: st.lists(v, max_size=5) | st.dictionaries(st.text(max_size=4), v, max_size=5), max_leaves=25)


def same(value):
    """The document with the values JSON lacks as their names."""
    if isinstance(value, float) and not math.isfinite(value):
        return {math.inf: "Infinity", -math.inf: "-Infinity"}.get(value, "NaN")
    if isinstance(value, list):
        return [same(v) for v in value]
    return {k: same(v) for k, v in value.items()} if isinstance(value, dict) else value


def put_together(rows):
    gone = {r[1:3] for r in rows if r[0] == "superseded"}
    doc = json.loads(rows[-1][4])
    for _, key, nth, pos, value in (r for r in rows if r[0] == "element" and r[1:3] not in gone):
        assert len(doc.setdefault(key, [])) == pos
        doc[key].append(json.loads(value))
    return doc


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.sampled_from(["a", "b", "data", "x y"]), VALUES, max_size=4), st.integers(1, 9), st.integers(0, 2))
def test_pull_reads_what_json_load_reads(doc, step, indent):
    text = json.dumps(doc, indent=indent or None, ensure_ascii=bool(indent))
    rows = list(json_pull.document([text[i:i + step] for i in range(0, len(text), step)], ["data", "b"]))
    whole = put_together(rows)
    expected = {k: v for k, v in same(doc).items() if not (v == [] and k in ("data", "b"))}
    assert whole == expected


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='{}[]:,"\\ae1.-tru NI\n', max_size=30), st.integers(1, 5))
def test_pull_rejects_what_json_load_rejects(text, step):
    try:
        json.loads(text)
        ok = True
    except ValueError:
        ok = False
    rows = list(json_pull.document([text[i:i + step] for i in range(0, len(text), step)], ["a"]))
    assert (rows[-1][4] is not None) == ok
    assert (json_pull.plain(text) is not None) == ok


def test_repeated_arrays_count_last():
    rows = list(json_pull.document(['{"data": [1, 2], "k": 1, "data": [3], "k": 2}'], ["data"]))
    assert put_together(rows) == {"data": [3], "k": 2}


def test_large_documents_give_the_same_tables(spark, tmp_path):
    """With a limit of 200 bytes nearly every document is pulled apart."""
    from bundle_factory import make_bundles
    make_bundles(str(tmp_path / "b"))
    with open(tmp_path / "b" / "m41_nan" / "speaker-meta.json", "w") as f:
        f.write('  {"0": "Jos\u00e9 }{ \\"x\\"", "1": "' + "y" * 300 + '"}  \n')
    with open(tmp_path / "b" / "m29_two_turns" / "transcript.json", "w") as f:
        f.write('{"data": [{"sentence": "old"}], "n": "' + "z" * 300 + '", "data": [{"sentence": "n\u00e9w"}, {"index": 7}]}\n')
    whole = BN.stage_bundles(spark, str(tmp_path / "b"), str(tmp_path / "s1"))
    apart = BN.stage_bundles(spark, str(tmp_path / "b"), str(tmp_path / "s2"), whole_bytes=200)
    assert apart.parts.count() > 20 and whole.parts.count() == 0
    status = [sorted(tuple(r) for r in BN.gate(x.files, folders=x.folders).collect()) for x in (whole, apart)]
    assert status[0] == status[1]
    tables = [ING.build_tables(spark, BN.accepted(x, BN.gate(x.files, folders=x.folders))) for x in (whole, apart)]
    for name in tables[0]:
        assert norm([tuple(r) for r in tables[0][name].collect()]) == norm([tuple(r) for r in tables[1][name].collect()]), name
    assert [r.sentence for r in tables[1]["transcript_segments"].filter("meeting_id = 'M29'").orderBy("id").collect()] == ["néw", ""]


def test_transcript_of_150_mb(spark, tmp_path):
    root, rng = tmp_path / "b", random.Random(4)
    turns = [turn(i, f"speaker {i % 7}", "word } { " * 120 + str(i), time=float("nan") if i % 1000 == 3 else float(i)) for i in range(130_000)]
    write(str(root), "big", bundle("BIG", "Long call"), skip=("transcript.json",))
    with open(root / "big" / "transcript.json", "w") as f:
        json.dump({"data": turns, "n": 1}, f)
    assert os.path.getsize(root / "big" / "transcript.json") > 150_000_000
    staged = BN.stage_bundles(spark, str(root), str(tmp_path / "s"))
    assert BN.gate(staged.files, folders=staged.folders).first().reason is None
    ids = staged.folders.selectExpr("folder", "'BIG' AS meeting_id")
    got = ING.transcript_turns(staged, ids).orderBy("pos").select("pos", "sentence", "time", "turn_index", "speaker_name").collect()
    assert len(got) == len(turns)
    for i in [*range(10), *(rng.randrange(len(turns)) for _ in range(500))]:
        t, r = turns[i], got[i]
        assert (r.pos, r.sentence, r.turn_index, r.speaker_name) == (i, t["sentence"], i, t["speaker_name"])
        assert r.time == t["time"] or math.isnan(r.time) and math.isnan(t["time"])


def test_only_empty_folders(spark, tmp_path):
    (tmp_path / "b" / "one").mkdir(parents=True)
    staged = BN.stage_bundles(spark, str(tmp_path / "b"), str(tmp_path / "s"))
    assert [tuple(r) for r in BN.gate(staged.files, folders=staged.folders).collect()] == [
        ("one", "missing", f"Missing file {ALL[0]} in one")]
