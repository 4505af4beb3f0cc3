"""The corpus pipeline: stage by stage against brute force, on odd tables, and without traces."""

import hashlib
import os
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from sonarium.llm import quality
from sonarium.llm.queries import tokenizer_file
from tests.llm import brute

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 8)))
    shared = " ".join(word() for _ in range(70))
    rows, labels = [], []
    for i in range(160):
        if i % 4 == 0:
            text, good = "buy### now!!! " * rng.randint(5, 30), 0
        else:
            words = [word() for _ in range(rng.randint(60, 200))]
            if i % 10 == 3:
                words[10:10] = shared.split()
            text, good = " ".join(words).capitalize() + ".", 1
        rows.append((i, text, rng.choice(["a", "a", "b", "c", None])))
        if i % 3 < 2:
            labels.append((i, good, 0))
    for i in range(12):  # copies, exact and near
        words = rows[4 * i + 1][1].split()
        if i % 2:
            words[5] = "changed"
        rows.append((200 + i, " ".join(words), "b"))
    rows += [(300, None, "a"), (301, "", "b"), (302, " ", None), (7, rows[7][1], "a"), (None, "Some words of a row that has no id at all, and are plain.", "c")]
    return rows, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = corpus()
    held = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    spark.createDataFrame(held, DOCUMENTS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def files(spark):
    from sonarium.llm import storage

    return set(os.listdir(storage.shared_dir(spark).removeprefix("file://")))


def test_every_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["quality", "near_dedup", "suffix_dedup", "mixing", "packing"]

    good = spark.createDataFrame(stages["quality"](spark, docs, folder).collect(), docs.schema)
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    cut = lambda t: model.utility(np.array([quality.text_features(t or "")]))[0] >= model.cut
    rows = docs.collect()
    assert sorted(map(str, good.collect())) == sorted(str(r) for r in rows if cut(r.text))
    assert all(r.doc_id % 4 for r in good.collect() if r.doc_id is not None and r.doc_id < 160)

    held = sorted(good.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    one = spark.createDataFrame(stages["near_dedup"](spark, good, folder).collect(), docs.schema)
    root = brute.similar_classes([r.text for r in held])
    assert sorted(map(str, one.collect())) == sorted(str(r) for i, r in enumerate(held) if root[i] == i)

    before = [(r.doc_id, r.text) for r in one.collect()]
    left = spark.createDataFrame(stages["suffix_dedup"](spark, one, folder).collect(), docs.schema)
    want = brute.repeats(before)
    assert sorted((str(r.doc_id), r.text) for r in left.collect()) == sorted((str(i), t[4]) for i, found in want.items() for t in found)
    assert all(r.n_chars == len(r.text) for r in left.collect()) and left.columns == columns
    assert sum(len(t or "") for _, t in before) > sum(r.n_chars for r in left.collect())

    mixed = stages["mixing"](spark, left, folder)
    assert mixed.columns == columns
    emitted = mixed.collect()
    times = {}
    for r in emitted:
        times[str(r)] = times.get(str(r), 0) + 1
    assert set(times) == {str(r) for r in left.collect()} and set(times.values()) <= {1, 2}
    sizes = lambda rows: {s: sum(len(r.text.split()) for r in rows if r.source == s) for s in {r.source for r in rows}}
    total, spent = sizes(left.collect()), sizes(emitted)
    assert all(total[s] <= spent[s] <= 1.5 * total[s] + 1 for s in total) and any(spent[s] > total[s] for s in total)

    mixed = spark.createDataFrame(emitted, docs.schema)
    check_packed(stages["packing"](spark, mixed, folder).collect(), emitted)


def check_packed(pieces, emitted):
    whole = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    by_row, by_sequence = {}, {}
    for p in pieces:
        by_row.setdefault((p.doc_id, p.row_id), []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    digest = lambda i, raw: (str(i), hashlib.sha256(raw).hexdigest())
    got = [digest(i, b"".join(bytes(p.ids) for p in sorted(own, key=lambda p: p.start))) for (i, _), own in by_row.items()]
    want = [digest(r.doc_id, np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for r in emitted]
    assert sorted(got) == sorted(want)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length == len(p.ids) // 4
            at += p.length
        assert at == 4096 or at & (at - 1) == 0


def test_run_leaves_one_table(spark, folder):
    before = files(spark)
    rows = pipeline.run(spark, folder).collect()
    left = {f for f in files(spark) - before if not f.startswith(".")}
    assert rows and {f.split("-")[0] for f in left} == {"mixing"}
    assert len({(r.row_id, r.start) for r in rows}) == len(rows)


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stages_on_empty_and_clashing_tables(spark, folder, name):
    stage = dict(pipeline.STAGES)[name]
    empty = spark.createDataFrame([], DOCUMENTS)
    assert stage(spark, empty, folder).count() == 0
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "", "x", "s", 0), (1, "a b c", None, "s", 5), (1, "a b c", None, "s", 5), (2, "long word " * 4000, "en", "s", 1)], DOCUMENTS)
    clash = odd.selectExpr("*", "1 as key", "2 as row", "3 as epochs", "4 as marks", "5 as kept_text", "'k' as bucket")
    out = stage(spark, clash, folder)
    if name != "packing":
        assert out.columns == clash.columns
        assert {(r.key, r.row, r.epochs, r.marks, r.kept_text, r.bucket) for r in out.collect()} <= {(1, 2, 3, 4, 5, "k")}
    else:
        assert sum(r.start == 0 for r in out.collect()) == 5
