"""Requests as functions of tables, and models at the boundary."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotline import api, models
from shotline.plans import joins, retrieval
from shotline.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return api.Tables(fx.frames(spark, SF), fx.vectors(spark, SF), fx.text_docs(spark, SF), fx.speech(spark, SF))


@pytest.fixture(scope="module")
def queries(spark):
    return fx.queries(spark, SF).where("query_id < 100")


def test_search_is_the_entry_query(spark, tables, queries):
    got = {(r.query_id, r["rank"], r.frame_id) for r in api.search(tables, queries).collect()}
    assert got == {(r.query_id, r["rank"], r.frame_id) for r in retrieval.entry_search(spark, SF).where("query_id < 100").collect()}
    one = api.search(tables, queries, 3, only=["a"]).where("query_id = 0").orderBy("rank").collect()
    assert one[0].frame_id == 0 and len(one) == 3 and api.models(tables) == ["a", "b"]
    with pytest.raises(ValueError):
        api.search(tables, queries, only=[])


def test_intelligent_search_uses_branches(tables, queries):
    plain = api.intelligent_search(tables, queries, k=10).collect()
    assert {(r.query_id, r.place) for r in plain} == {(q, p) for q in (0, 50) for p in range(1, 11)}
    ids = lambda **kw: [r.frame_id for r in api.intelligent_search(tables, queries, k=50, **kw).where("query_id = 0").orderBy("place").collect()]
    both = ids(ocr=("from he", "la"), asr=("la",))
    assert both != ids() and both == ids(ocr=("from he", "la"), asr=("la",))
    assert ids(ocr=("zebra quagga",)) == ids() and ids(ocr=("la",), asr=("LA", "he"), joint=True)
    shots = [r.shot_id for r in api.intelligent_search(tables, queries, ocr=("la",), k=10).where("query_id = 0").collect()]
    assert max(map(shots.count, shots)) <= 2
    with pytest.raises(ValueError):
        api.intelligent_search(tables, queries, mode="other")


def test_text_searches(tables):
    assert {r.frame_id for r in api.ocr_search(tables, "from he la", 5).collect()} and api.asr_search(tables, "la", 5).count() <= 5
    for f in (api.ocr_search, api.asr_search):
        with pytest.raises(ValueError, match="empty"):
            f(tables, " ")


def test_scores_chains_shots_and_segments(spark, tables, queries):
    assert api.sub_score(tables, queries, 11).count() == 4
    b = queries.select(F.col("query_id").cast("string").alias("query_id"), F.lit("x").alias("branch"), "model", "q")
    found = api.detail_two_stage(tables, b.where("model = 'a'"), b.where("model = 'b'"), 5, 40).collect()
    assert {r.query_id for r in found} == {"0", "50"} and len(found) == 10
    events = [joins._event(spark, SF, k).withColumn("shot_id", F.lit(None).cast("string")) for k in ("view", "click", "purchase")]
    top = api.trake_search(events, 172_800.0, 7).collect()
    assert len(top) == 7 and top[0].score >= top[-1].score
    with pytest.raises(ValueError):
        api.trake_search(events[:1])
    from shotline.plans import moments

    got = api.vqa_candidates(fx.event_results(spark, SF), fx.whole_results(spark, SF), moments.REQUIRED, moments.CONTEXT)
    assert got.count() <= 10
    assert api.video_shots(tables, 3).count() == 50
    f = joins._similar(spark, SF)
    segments = api.temporal_search(tables, f, joins._seeds(f).where("seed_id % 100 = 12")).collect()
    assert segments and all(r.first_ts <= r.last_ts for r in segments)


class Double:
    """A stand-in: vectors from lengths, with one that isn't finite at first."""

    dimension = 2

    def embed_images(self, paths):
        return np.array([[np.nan if len(paths) > 1 and p == "b" else 3.0, 4.0] for p in paths])

    def embed_text(self, texts):
        return np.array([[float(len(t)), 0.0] for t in texts])

    def rerank(self, query, candidates):
        return [float(len(query) * len(c)) for c in candidates]

    def caption(self, paths):
        return [p.upper() for p in paths]

    def transcribe(self, path):
        return [(float(k), k + 1.0, f"{path}{k}") for k in range(2)]

    def detect(self, path):
        return [(0, 9), (10, 19)]


def test_models_meet_tables(spark):
    frames = spark.createDataFrame([(1, "a"), (2, "b")], "frame_id long, frame_path string").coalesce(1)
    assert all(np.allclose(r.embedding, [0.6, 0.8]) for r in models.embed_frames(frames, Double, "m").collect())
    q = models.embed_queries(spark.createDataFrame([(1, "xyz")], "query_id long, text string"), Double, "m").first()
    assert (q.query_id, q.model) == (1, "m") and np.allclose(q.q, [1.0, 0.0])
    rows = spark.createDataFrame([(1, "q", 5, "ab"), (1, "q", 6, "abc"), (2, "qq", 5, "a")], "query_id long, query string, frame_id long, candidate string")
    assert {(r.query_id, r.frame_id): r.model_score for r in models.reranked(rows, Double).collect()} == {(1, 5): 2.0, (1, 6): 3.0, (2, 5): 2.0}
    assert {r.text for r in models.described(frames, Double, "caption").collect()} == {"A", "B"}
    videos = spark.createDataFrame([(7, "v")], "video_id long, path string")
    assert [r.text for r in models.transcribed(videos, Double).orderBy("start_sec").collect()] == ["v0", "v1"]
    assert models.detected(videos, Double).count() == 2
    with pytest.raises(ValueError, match="finite"):
        models.unit_rows(np.array([[np.inf, 1.0]]))
