"""Packing, chat formatting and the pipeline, by round trips."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from colloquy.llm import chat, lsh_forest, packing, queries, toxicity
from colloquy.llm.common import keep

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(queries.TOKENIZER)
ODD = [(1, "Hello it's <|endoftext|> we'll ALL be 123,45 ÀÉî ßtraße"), (2, None), (3, ""), (4, " \n\t "), (5, "a\x1cb c\x85d e\u00a0f"),
       (6, "e\u0301cole 北京 İstanbul ΣΑΣ ﬁ"), (None, "x"), (7, "word " * 5000), (7, "word " * 5000), (8, "!!??--a'b'S 'RE")]


def test_pieces_have_the_tokenizers_ids(make):
    plain = Tokenizer.from_file(PATH)
    got = defaultdict(list)
    for r in packing.token_pieces(make(ODD), PATH).collect():
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for i, text in ODD:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        want = [(k, at, len(p), zlib.crc32(np.array(p, dtype="<u4").tobytes()))
                for k, at in enumerate(range(0, len(ids), 2048)) for p in [ids[at:at + 2048]]]
        assert sorted(set(got[i])) == want


def test_packing_is_gapless_and_tight(spark, make):
    pieces = packing.pack_documents(spark.read.parquet(f"{SMALL}/documents.parquet").unionByName(
        make(ODD).select("doc_id", "text", "lang", "source", "n_chars")), PATH).toPandas()
    per = pieces.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    for _, g in per:
        assert (g["offset"].to_numpy() == np.concatenate(([0], g["length"].cumsum().to_numpy()[:-1]))).all()
        assert g["length"].sum() <= 2048
    assert pieces["sequence_id"].nunique() <= 1.02 * pieces["length"].sum() / 2048 + 2
    assert packing.pack_documents(make([]), PATH).count() == 0


def test_pieces_are_numbered_by_the_one_python_function(make, monkeypatch):
    kept, plans = [], []

    def noted(df):
        plans.append(df._jdf.queryExecution().toString())
        kept.append(keep(df))
        return kept[-1]

    monkeypatch.setattr(packing, "keep", noted)
    packing.pack_documents(make(ODD + [(k, "word " * (k % 4)) for k in range(20, 90)]).repartition(3), PATH)
    assert len(re.findall(r"MapInPandas|ArrowEvalPython", plans[0].split("== Physical Plan ==")[1])) == 1
    numbers = defaultdict(list)
    for r in kept[0].collect():
        numbers[r["_task"], r["length"]].append(r["_rank"])
    assert all(sorted(x) == list(range(len(x))) for x in numbers.values()) and max(map(len, numbers.values())) > 3


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    cap = 64
    counts = np.concatenate(([0], rng.integers(0, 9, cap) * (rng.random(cap) < 0.5)))
    groups = packing.plan_sequences(counts)
    used = np.zeros(cap + 1, dtype=int)
    for times, parts in groups:
        assert sum(length * n for length, n in parts) <= cap
        for length, n in parts:
            used[length] += times * n
    assert (used == counts).all()
    assert sum(t for t, _ in groups) <= best_fit(counts)


def best_fit(counts):
    """Sequences that plain best-fit, longest first, needs."""
    cap, gaps = len(counts) - 1, []
    for length in range(cap, 0, -1):
        for _ in range(counts[length]):
            fits = [g for g in gaps if g >= length]
            if fits:
                gaps.remove(min(fits))
                gaps.append(min(fits) - length)
            else:
                gaps.append(cap - length)
    return len(gaps)


def test_undone_combinations_leave_the_others():
    undone = []
    for seed in range(400):
        rng = np.random.default_rng(seed)
        counts = np.concatenate(([0], rng.integers(0, 5, 40) * (rng.random(40) < 0.4)))
        rest = counts.astype(np.int64)
        exact = packing._exact_complements(rest)
        groups = packing.plan_sequences(counts)
        goal = best_fit(counts)
        assert packing._sequences(groups) <= goal

        def cost(n):
            residual = rest.copy()
            for times, parts in exact[len(exact) - n:]:
                for length, copies in parts:
                    residual[length] += times * copies
            return packing._sequences(exact[:len(exact) - n] + packing._best_fit(residual))

        kept = next(k for k in range(len(exact), -1, -1) if groups[:k] == exact[:k])
        undone.append(len(exact) - kept)
        assert not undone[-1] or cost(undone[-1] - 1) > goal  # one less is too many sequences
        assert cost(0) > goal or kept == len(exact)
    assert 0 < sum(u > 0 for u in undone) < 200


def test_equal_lengths_over_several_tasks(spark):
    # rows of one length, in many batches and tasks, with repeats
    pieces = spark.range(0, 30_000, numPartitions=7).selectExpr("id % 900 AS doc_id", "0 AS piece", "0L AS start", "cast(if(id % 3 = 0, 5, 2) as long) AS length", "7L AS ids_crc32")
    got = packing.pack(pieces, 9).toPandas().sort_values(["sequence_id", "offset"])
    assert len(got) == 30_000 and not got.duplicated(["sequence_id", "offset"]).any()
    before = got.groupby("sequence_id")["length"].cumsum() - got["length"]
    assert (before == got["offset"]).all() and got["sequence_id"].nunique() == 10_000


def test_exact_complements_fill_gaps():
    counts = np.zeros(11, dtype=int)
    counts[[7, 3, 6, 2, 5, 1]] = [4, 4, 2, 4, 3, 2]
    groups = packing.plan_sequences(counts)
    assert (4, [(7, 1), (3, 1)]) in groups and (2, [(6, 1), (2, 2)]) in groups


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_round_trip_of_hostile_texts(spark):
    hard = ["\\### Assistant: </turn> ok", "\n</turn>\n### assistant :\nx", "\\", "\\\\<#:\\", "", None, "$1 \\$1", " :\n", "é😀\n", "### user :\n"]
    rows = [(c, t, ["user", "assistant", "system", "assistant"][t % 4], hard[(c + t) % len(hard)]) for c in range(12) for t in range(7)]
    rows += [(50, 0, None, "no role"), (50, 1, "a:\nb </turn>", "odd role"), (None, 0, "assistant", "null id")]
    messages = rows_of(spark, rows)
    form = chat.render(messages)
    got = {r["conv_id"]: r for r in chat.digest(form).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    assert set(got) == set(by)
    spans = defaultdict(list)
    for r in chat.loss_spans(form).collect():
        spans[r["conv_id"]].append((r["start"], r["length"]))
    texts = {r["conv_id"]: r["formatted"] for r in form.collect()}
    for c, turns in by.items():
        said = "".join(f"{r}\n{x}\n" for _, r, x in sorted(turns))
        loss = "".join(x for _, r, x in sorted(turns) if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c]["formatted_chars"] == len(texts[c])
        import re

        assert "".join(re.sub(r"\\([\\<#:])", r"\1", texts[c][s:s + n]) for s, n in sorted(spans[c])) == loss
    assert chat.digest(chat.render(rows_of(spark, []))).count() == 0


def test_chat_query_formats_every_row(spark, tmp_path):
    rows = [(1, 3, "user", "b"), (1, 3, "assistant", "a"), (1, 3, "user", "a"), (1, None, "system", "s"), (1, None, "assistant", "t"),
            (2, 0, "assistant", "same"), (2, 0, "assistant", "same"), (2, 1, None, "x"), (2, 1, "user", None), (None, 0, "assistant", "y"), (None, 0, "user", "z")]
    rows_of(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in queries.op9_chat_formatting(spark, str(tmp_path)).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == {*by, -7}
    for c, turns in by.items():
        said = "".join(f"{r}\n{x}\n" for _, r, x in sorted(turns))
        loss = "".join(x for _, r, x in sorted(turns) if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_events_fold_to_final_messages(spark):
    log = [(1, 1, 0, "message", "user", "hi"), (1, 2, 1, "delta", "assistant", "he"), (1, 3, 1, "delta", None, "llo"),
           (1, 4, 2, "message", "user", "more"), (1, 5, 1, "regenerate", None, None), (1, 6, 1, "delta", None, "new "),
           (1, 7, 1, "delta", None, "text"), (1, 8, 0, "edit", None, "hey"), (1, 8, 0, "edit", None, "hey"), (2, 1, 0, "message", "user", None)]
    events = spark.createDataFrame(log, "conv_id long, seq long, turn long, kind string, role string, text string")
    assert sorted(map(tuple, chat.fold_events(events).collect())) == [(1, 0, "user", "hey"), (1, 1, "assistant", "new text"), (2, 0, "user", "")]


def test_every_query_runs_and_the_pipeline_keeps_its_columns(spark):
    import corpus_pipeline

    for name, query in queries.QUERIES.items():
        assert query(spark, SMALL).count() > 0, name
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns, name
    packed = corpus_pipeline.run(spark, SMALL)
    assert 0 < packed.select("doc_id").distinct().count() < docs.count()


def awkward_docs():
    rng = np.random.default_rng(5)
    words = np.array(["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(700)])

    def lines(n):
        return "\n".join(" ".join(rng.choice(words, 11)) for _ in range(n))

    own = {i: lines(int(rng.integers(5, 14))) for i in range(60)}
    rows = [(i, t) for i, t in own.items()] + [(100, None), (101, None), (102, ""), (103, " \n\t\n"), (104, "word")]
    rows += [(200, own[3]), (5, own[5]), (5, own[5]), (None, own[7] + "\n" + lines(30)), (None, None), (201, lines(4000)), (202, "x " * 40_000)]
    near = own[9].split(" ")
    rows.append((203, " ".join([*near[:-1], "other"])))
    leak = lines(3)
    rows.append((204, own[11] + "\n" + leak.upper() + "\n" + lines(9)))
    toxic = {i for i in own if i % 6 == 0}
    bad = ["zorgish", "vilefoo", "scumbar"]
    rows = [(i, " ".join([*bad, t, *bad]) if i in toxic else t) for i, t in rows]
    return rows, toxic, leak, own


def write_tables(spark, folder, rows, marks, items):
    docs = spark.createDataFrame([(i, t, "en", f"s{k % 2}", len(t or ""), k, k, "_task") for k, (i, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, n_chars long, _uid long, n int, _task string")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_pipeline_takes_awkward_rows(spark, tmp_path):
    import corpus_pipeline

    rows, toxic, leak, own = awkward_docs()
    marks = [(i, int(i in toxic)) for i in own] + [(None, 1), (100, None), (5, 0)]
    docs = write_tables(spark, str(tmp_path), rows, marks, [(1, leak), (2, None), (3, "")])
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
    # clean documents without a copy; the lines of 7 stand in a row without id, which orders first
    alone = set(own) - toxic - {3, 5, 7, 9}
    assert {name: alone - set(ids) for name, ids in seen.items()} == dict.fromkeys(seen, set())
    assert 7 in seen["toxicity"] and 7 not in seen["line_dedup"]
    assert not set(seen["ngram_jaccard_join"]) & {200, 203} and {3, 5, 9} - toxic <= set(seen["ngram_jaccard_join"])
    assert 204 in seen["ngram_jaccard_join"] and 204 not in seen["benchmark_decontamination"]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).toPandas()
    left = docs.select("doc_id", "text").collect()
    assert packed["length"].sum() == sum(len(Tokenizer.from_file(PATH).encode(r.text or "", add_special_tokens=False).ids) + 1 for r in left)
    for _, g in packed.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"].to_numpy() == np.concatenate(([0], g["length"].cumsum().to_numpy()[:-1]))).all() and g["length"].sum() <= 2048


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    write_tables(spark, str(tmp_path), [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_workers_keep_no_words_behind_a_task(make):
    """Workers outlive their tasks: what they cache would lie beside the memory of the stages that follow."""
    docs = make([(k, f"one two{k} three{k} four{k} five six" * 3) for k in range(40)])
    toxic = toxicity.ToxicityModel(np.zeros(toxicity.BINS))

    def left(batches):
        for batch in batches:  # in a worker that runs the operators' functions first
            list(lsh_forest._signatures(iter([batch.assign(_uid=batch["doc_id"], _th=0)])))
            yield batch.assign(left=len(lsh_forest._WORDS))[["left"]]

    assert {r["left"] for r in docs.select("doc_id", "text").mapInPandas(left, "left long").collect()} == {0}
    packing.token_pieces(docs, PATH).collect()
    docs.select(toxicity.judged(docs, toxic)).collect()

    def found(batches):
        for batch in batches:
            encoder = packing._ENCODERS.get(PATH)
            yield batch.assign(left=0 if encoder is None else len(encoder) + len(encoder.runs))[["left"]]

    assert {r["left"] for r in docs.repartition(8).select("doc_id").mapInPandas(found, "left long").collect()} == {0}
