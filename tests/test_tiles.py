"""Tiles of queries and vectors against the plain operators over all pairs, odd vectors included."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from shotline.operators import fusion, ranking, tiles, vector
from shotline.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
ODD = {7: [1.0, 2.0, 3.0], 8: [1.0, 2.0, 3.0], 9: [1.0, 2.0, 3.0], 11: None, 12: [1.0, None, 2.0], 13: [1.0, 2.0], 14: [float("nan"), 1.0, 1.0], 15: [0.0, 0.0, 0.0], 16: []}


@pytest.fixture()
def odd(spark, monkeypatch):
    """Vectors of two models and queries: copies, null, holes, other lengths, NaN, zeros, one query twice; several tiles."""
    monkeypatch.setattr(tiles, "LEAST", 20)
    random.seed(1)
    rows = [(m, k, ODD.get(k, [random.gauss(0, 1) for _ in range(3)])) for m in "ab" for k in range(60)]
    v = spark.createDataFrame(rows, "model string, frame_id long, embedding array<double>")
    q = v.where("frame_id % 3 = 0 or frame_id in (7, 11, 13, 14, 16)").select(F.col("frame_id").alias("query_id"), "model", F.col("embedding").alias("q"))
    return v, q.unionByName(q.where("query_id = 9"))


def rows(df, *columns):
    return sorted(repr(tuple(r)) for r in df.select(*columns).collect())


def pair_free(spark, name):
    """No expression over pairs of vectors is left in the query's plan."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    return "zip_with" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("k", [1, 5, 30])
def test_hits(odd, k):
    columns = ("query_id", "model", "frame_id", "score", "rank")
    assert rows(vector.top_k(*odd, k), *columns) == rows(vector.best(vector.scored(*odd), k), *columns)


def test_F15_lists_are_cut_in_tiles(spark):
    assert pair_free(spark, "F15_auxiliary_merge")


@pytest.mark.parametrize("k", [2, 7])
def test_F2_weighted_sums(spark, odd, k):
    assert pair_free(spark, "F2_wsf")
    v, q = odd
    q, names, weights, columns = q.dropDuplicates(["query_id", "model"]), ["a", "b"], {"a": 3.0}, ("query_id", "frame_id", "score", "rank")
    assert rows(fusion.wsf_search(v, q, names, weights, k), *columns) == rows(fusion.wsf(vector.scored(v, q), ["query_id"], names, weights, k), *columns)
    with pytest.raises(Exception, match="models have different frames"):
        fusion.wsf_search(v.where("model = 'a' or frame_id <> 5"), q, names, weights, k).collect()


@pytest.mark.parametrize("kept", ["true", "model = 'a' or frame_id % 7 <> 0", "model = 'b'"])
def test_F3_means(spark, odd, kept):
    assert pair_free(spark, "F3_weighted_sum")
    v, q = odd
    v, q, columns = v.where(kept), q.where("query_id <> 9 and (model = 'a' or query_id <> 15)"), ("query_id", "frame_id", "score")
    assert rows(tiles.mean(v, q), *columns) == rows(fusion.weighted_sum(vector.scored(v, q), ["query_id"], "model"), *columns)


def test_V3_lists_are_cut_in_tiles(spark, odd):
    """Before any shuffle each tile keeps k rows of a query and model (and as many without a number)."""
    assert pair_free(spark, "V3_variant_max_merge")
    most = tiles.hits(*odd, 2).groupBy("query_id", "model").count().agg(F.max("count")).first()[0]
    assert most <= 2 * 3 * 2 * 6  # twice the query 9, three kinds of scores, six tiles


def test_W1_ranks(spark, odd):
    assert pair_free(spark, "W1_ranks")
    v, q = odd
    for asked in (q, q.dropDuplicates(["query_id", "model"])):
        columns = ("query_id", "model", "frame_id", "rank")
        assert rows(tiles.ranks(v, asked), *columns) == rows(ranking.ranked(vector.scored(v, asked), ["query_id", "model"], [F.desc("score"), "frame_id"]), *columns)


def test_F8_hits_and_phrases(spark):
    """Hits come from tiles; a phrase looks at the places of its first word, whose number is that of a phrase of one word."""
    from shotline.operators import text

    assert pair_free(spark, "F8_evidence_rerank")
    docs = spark.createDataFrame([(1, "he la he la la he"), (2, "he he he"), (3, "la"), (4, None), (5, "")], "doc_id long, text string")
    d = text._digest(docs, [["he"], ["he", "la"], ["he", "he"], []], ["he", "la"], "text")
    assert "sequence(" not in d._jdf.queryExecution().optimizedPlan().toString()
    assert {r.doc_id: list(r.pf) for r in d.collect()} == {1: [3, 2, 0, 0], 2: [3, 0, 2, 0], 3: [0, 0, 0, 0], 4: [0, 0, 0, 0], 5: [0, 0, 0, 0]}


def test_T13_hits_and_plain_tokens(spark):
    """Hits come from tiles; ASCII texts skip the folding that cannot change them, others don't."""
    from shotline.functions import scalar

    assert pair_free(spark, "T13_caption_retrieval")
    docs = spark.createDataFrame([("From HE_2, the la",), ("Fröm HÉ_2, the łaß",), (None,), ("",)], "text string")
    found = docs.select(scalar.tokens(F.col("text")).alias("ts"))
    assert "octet_length" in found._jdf.queryExecution().optimizedPlan().toString()
    assert [r.ts for r in found.collect()] == [["from", "he_2", "la"], ["from", "he_2", "lass"], None, []]
