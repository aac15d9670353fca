"""Queries take whole texts, every frame, every query of the stated set, and the evidence of all documents."""

from __future__ import annotations

import glob
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from shotline.operators import vector
from shotline.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def long_docs(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("long")
    text = "word " * 60 + "Zebras text said of the end"
    spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize(
    "name, column, end",
    [("X1_normalise", "folded", "of the end"), ("X2_normalise_words", "words", "of the end"), ("X3_keyword_variants", "variants", "of the end"), ("X4_answer", "answer", "of the end"),
     ("X5_short_answer", "answer", "of the end"), ("X15_slug", "slug", "of-the-end"), ("X17_label_tokens", "label", "text word zebra")],
)
def test_whole_text_to_its_end(spark, long_docs, name, column, end):
    assert QUERIES[name](spark, long_docs).first()[column].endswith(end)


def test_phrase_and_signal_behind_the_head(spark, long_docs):
    assert QUERIES["X6_phrase"](spark, long_docs).first().found
    assert QUERIES["X11_router_signals"](spark, long_docs).first().ocr == 0.8


@pytest.mark.parametrize("name, column", [("W3_forward_scan", "seed_id"), ("W4_backward_scan", "seed_id")])
def test_every_frame(spark, name, column):
    assert sorted(r[column] for r in QUERIES[name](spark, SF).select(column).collect()) == list(range(500))


def test_moments_between_the_tens(spark):
    assert any(r.moment_id % 10 for r in QUERIES["J14_interval_overlap"](spark, SF).collect())


def test_every_file_has_a_fingerprint(spark):
    found = sorted(r.checksum for r in QUERIES["S2_fingerprints"](spark, SF).collect())
    assert found == sorted(hashlib.sha256(open(p, "rb").read()).hexdigest() for p in glob.glob(f"{SF}/*.parquet"))


def test_all_queries_are_run(spark):
    assert {r.query_id for r in QUERIES["entry_search"](spark, SF).select("query_id").collect()} == set(range(0, 500, 50))
    assert not [n for n, s in ORACLE_SQL.items() if "(0, 7, 42)" in s or n.endswith("_whole")]


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_blocks_score_every_pair_once(spark, size):
    random.seed(5)
    rows = [(m, k, [random.gauss(0, 1) for _ in range(3)]) for m in "ab" for k in range(30)]
    v = spark.createDataFrame(rows, "model string, frame_id long, embedding array<double>")
    q = v.where("frame_id % 3 = 0").select(F.col("frame_id").alias("query_id"), "model", F.col("embedding").alias("q"))
    assert sorted(vector.scored_in_blocks(v, q, size).collect()) == sorted(vector.scored(v, q).collect())


def test_evidence_of_all_documents(spark, tmp_path):
    """Documents far behind the first ones lift their frame."""
    random.seed(4)
    vectors = [(k, [random.gauss(0, 1) for _ in range(4)], 0) for k in range(20)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")

    def found(docs):
        spark.createDataFrame([(d, t) for d, t in docs], "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        return {(r.query_id, r.frame_id): (r.place, r.score) for r in QUERIES["F8_evidence_rerank"](spark, str(tmp_path)).collect()}

    filler = [(500 * 60 + 2 * k, "quiet water") for k in range(4)]
    without = found(filler)
    last = max((f for q, f in without if q == 0 and f % 2 == 0), key=lambda f: without[0, f])
    with_more = found([*filler, (last + 500 * 38, "from he la and more words from he"), (2 + 500 * 37, "la once in a long quiet text about water")])
    assert with_more[0, last][1] > without[0, last][1] + 0.05 and with_more[0, last][0] <= without[0, last][0]
