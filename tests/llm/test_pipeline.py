"""The pipeline stage by stage, each on its own input."""

from __future__ import annotations

import glob

import corpus_pipeline
import pytest
from shotline.llm import pii

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        folder = str(tmp_path_factory.mktemp("stage") / str(k))
        f(spark, docs, SF).write.parquet(folder)
        after = spark.read.parquet(folder)
        out.append((name, docs, after))
        docs = after
    return out


def test_columns_stay(stages):
    for _, before, after in stages[:-1]:
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert after.count() <= before.count()


def test_clean_documents_stay_and_junk_goes(spark, stages):
    y = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[0][2].collect()}
    assert all(i in kept for i, q in y.items() if q == 1)
    assert sum(i in kept for i, q in y.items() if q == 0) <= 2


def test_one_of_each_class(stages):
    from tests.llm.test_operators import brute_classes

    before = [(r.doc_id, r.text) for r in stages[2][1].collect()]
    assert {r.doc_id for r in stages[2][2].collect()} == set(brute_classes(before).values())


def test_personal_data_is_gone(stages):
    before = {r.doc_id: r.text for r in stages[3][1].collect()}
    after = {r.doc_id: r for r in stages[3][2].collect()}
    for i, t in before.items():
        found = pii.spans(t)
        assert (after[i].text == t) == (not found) and after[i].n_chars == len(after[i].text)
        assert not [s for s in pii.spans(after[i].text) if s[0] in pii.BASE]


def test_all_tokens_are_packed(stages):
    docs = {r.doc_id for r in stages[4][1].collect()}
    pieces = stages[4][2].collect()
    got = {}
    for r in pieces:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert set(got) == docs and all(got[r.doc_id] == r.doc_tokens for r in pieces)


def test_run_gives_the_last_stage(spark, stages):
    key = lambda r: (r.doc_id, r.start)
    one = {key(r): 0 for r in corpus_pipeline.run(spark, SF).collect()}
    assert {k[0] for k in one} == {r.doc_id for r in stages[4][2].collect()}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, y int, class_id long, key string"
LABELS = "doc_id long, quality int, toxic int"


def run_on(spark, folder, rows, labels):
    d = spark.createDataFrame([(i, t, "xx", "s", None if t is None else len(t), 0.5, 1, 2, "k") for i, t in rows], SCHEMA)
    d.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    return corpus_pipeline.run(spark, str(folder)).collect()


def prose(k, n=60):
    return " ".join(f"{w} of the {w}{k}" for w in "river stone light house field".split())[:400] + f" and then number {k} " + " ".join(f"w{k}x{j} the" for j in range(n))


def test_edges_through_run(spark, tmp_path):
    """Nulls, empty, repeated and very long texts, rows that share a doc_id, ties, and columns of any name."""
    long = prose(9) + " " + " ".join(f"word{j} the" for j in range(60_000))
    rows = [(1, prose(1)), (2, prose(2)), (2, prose(2)), (3, prose(1)), (4, None), (5, ""), (6, " \n"), (None, prose(7)), (8, prose(8)), (8, prose(88)), (9, long), (10, "z # $ % " * 30)]
    got = run_on(spark, tmp_path, rows, [(i, int(i != 10), 0) for i in (1, 2, 8, 9, 10)] + [(1, None, None), (None, 1, 1)])
    tokens = {}
    for r in got:
        tokens.setdefault(r.doc_id, []).append(r)
    assert set(tokens) == {1, 2, None, 8, 9}
    assert sum(r.start == 0 for r in tokens[8]) == 2 and all(sum(r.start == 0 for r in tokens[i]) == 1 for i in (1, 2, None, 9))
    assert sum(r.length for r in tokens[9]) == tokens[9][0].doc_tokens > 100_000


def test_empty_tables_through_run(spark, tmp_path):
    assert run_on(spark, tmp_path / "a", [], []) == []
    assert {r.doc_id for r in run_on(spark, tmp_path / "b", [(1, prose(1)), (2, prose(2))], [])} == {1, 2}


def test_stage_folders_go(spark, tmp_path):
    from shotline.llm import common

    before = set(glob.glob(common.shared_dir(spark).removeprefix("file:") + "/pipeline-*"))
    run_on(spark, tmp_path, [(1, prose(1))], [(1, 1, 0)])
    new = set(glob.glob(common.shared_dir(spark).removeprefix("file:") + "/pipeline-*")) - before
    assert [p.rsplit("/", 1)[1][:10] for p in new] == ["pipeline-3"]
