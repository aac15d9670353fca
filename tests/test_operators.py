"""Greedy operators against loops, and small expected values."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotline.operators import chains, fusion, quality, ranking, temporal, text
from shotline.sources import store
from shotline.streaming import ingest


def test_near_suppression_is_greedy(spark):
    random.seed(1)
    rows = [("k", 1, 1, "n", float(random.randint(0, 40)), k, k) for k in range(30)]
    kept = []
    for r in rows:
        if not any(abs(r[4] - y[4]) <= 2 for y in kept):
            kept.append(r)
    df = spark.createDataFrame(rows, "keyword string, video_id long, shot_id long, norm string, ts double, rank long, doc_id long")
    assert {r.doc_id for r in text.suppress_near(df).collect()} == {r[6] for r in kept}


def test_word_chunks(spark):
    random.seed(2)
    rows = [(v, k, float(k), " ".join(["w"] * random.randint(0, 9))) for v in range(6) for k in range(20)]
    df = spark.createDataFrame(rows, "video_id long, doc_id long, start_sec double, text string")
    expected = set()
    for v in range(6):
        out = []
        for r in rows:
            if r[0] == v:
                n = len(r[3].split())
                if out and out[-1][0] + n <= 12:
                    out[-1] = (out[-1][0] + n, out[-1][1] + 1)
                else:
                    out.append((n, 1))
        expected |= {(v, k, *c) for k, c in enumerate(out)}
    assert {tuple(r) for r in temporal.word_chunks(df, 12).collect()} == expected


def test_evidence_frames(spark):
    """Anchors, neighbours of answers in their shot, the global hit, then the farthest: against a loop."""
    random.seed(3)
    frames, candidates, anchors, expected = [], [], [], []
    for c in range(12):
        fs = [(c, k // 5, 100 * c + k, float(random.randint(0, 60))) for k in range(random.choice([0, 3, 14]))]
        fs.sort(key=lambda f: (f[3], f[2]))
        frames += fs
        start, end = 10.0, 40.0
        candidates.append((c, c, start, end))
        own = random.sample(fs, min(len(fs), 3)) if c % 3 else []
        own = [(c, k, f[2], f[1], f[3], kind) for k, (f, kind) in enumerate(zip(own, ("anchor", "answer", "global"), strict=False), 1)]
        anchors += own
        chosen = [(r[4], r[2]) for r in own if r[5] != "global"]
        for r in own:
            if r[5] == "answer":
                at = [f[2] for f in fs].index(r[2])
                for n in (at - 1, at + 1):
                    if 0 <= n < len(fs) and fs[n][1] == r[3] and start - 2 <= fs[n][3] <= end + 2 and (fs[n][3], fs[n][2]) not in chosen:
                        chosen.append((fs[n][3], fs[n][2]))
        chosen += [(r[4], r[2]) for r in own if r[5] == "global" and (r[4], r[2]) not in chosen]
        free = [(f[3], f[2]) for f in fs if start - 2 <= f[3] <= end + 2 and (f[3], f[2]) not in chosen]
        while free and len(chosen) < 8:
            pick = min(free, key=lambda p: (abs(p[0] - (start + end) / 2), p)) if not chosen else min(free, key=lambda p: (-min(abs(x[0] - p[0]) for x in chosen), p))
            free.remove(pick)
            chosen.append(pick)
        expected += [(c, k, f) for k, (_, f) in enumerate(chosen[:8], 1)]
    got = chains.evidence_frames(
        spark.createDataFrame(candidates, "candidate_id long, video_id long, start_sec double, end_sec double"),
        spark.createDataFrame(anchors, "candidate_id long, priority int, frame_id long, shot_id long, ts double, kind string"),
        spark.createDataFrame(frames, "video_id long, shot_id long, frame_id long, ts double"), 8,
    )
    assert sorted((r.candidate_id, r.place, r.frame_id) for r in got.collect()) == sorted(expected)


@pytest.mark.parametrize("width", [0.5, 7.0, 1e6])
def test_nearest_equals_a_loop_for_any_buckets(spark, width):
    random.seed(6)
    frames = sorted((v, 100 * v + k, float(random.randint(0, 300))) for v in range(3) for k in range(20))
    probes = [(p, random.randint(0, 3), float(random.randint(-20, 400))) for p in range(60)]
    got = temporal.nearest(spark.createDataFrame(probes, "probe_id long, video_id long, at double"), spark.createDataFrame(frames, "video_id long, frame_id long, ts double"), width)
    expected = {}
    for p, v, at in probes:
        own = sorted((ts, f) for w, f, ts in frames if w == v)
        before, behind = [x for x in own if x[0] < at], [x for x in own if x[0] >= at]
        near = before[-1:] + behind[:1]
        if near:
            expected[p] = min(near, key=lambda x: abs(x[0] - at))[1]
    assert {r.probe_id: r.frame_id for r in got.collect()} == expected


def test_intervals_and_overlaps_equal_loops(spark):
    random.seed(7)
    iv = [(k, k % 3, float(a := random.randint(0, 200)), float(a + random.choice([0, 3, 45, 130]))) for k in range(40)]
    frames = [(v, 1000 * v + k, float(random.randint(0, 300))) for v in range(3) for k in range(15)]
    mapped = temporal.map_intervals(spark.createDataFrame(iv, "doc_id long, video_id long, start_sec double, end_sec double"), spark.createDataFrame(frames, "video_id long, frame_id long, ts double"))
    inside = {(d, f) for d, v, a, b in iv for w, f, t in frames if v == w and a - 2 <= t <= b + 2}
    got = {(r.doc_id, r.frame_id): r.weight for r in mapped.collect()}
    alone = {d for d, *_ in iv} - {d for d, _ in inside}
    assert inside <= set(got) and {d for d, _ in set(got) - inside} == alone and len(got) == len(inside) + len(alone)
    moments = [(k, k % 3, float(a := random.randint(0, 250)), float(a + random.choice([0, 10, 90]))) for k in range(25)]
    over = temporal.overlap(spark.createDataFrame(moments, "moment_id long, video_id long, m_start double, m_end double"), spark.createDataFrame(iv, "doc_id long, video_id long, start_sec double, end_sec double"), k=1000, width=20.0)
    assert sorted((r.moment_id, r.doc_id) for r in over.collect()) == sorted((m, d) for m, v, a, b in moments for d, w, x, y in iv if v == w and x <= b + 2 and y >= a - 2)


def test_chain_scores_without_a_maximum(spark):
    rows = [(1, 1, 2, 0.0, 0.5), (1, 1, 3, 0.0, 1.0), (1, 1, 3, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "video_id long, e0 long, e1 long, s0 double, s1 double")
    assert {(r.e1, r.score) for r in chains.chain_scores(df, 2).collect()} == {(2, 0.25), (3, 0.5)}


def test_chains_join_by_shot_ids_and_without_times(spark):
    pairs = "video_id long, f_i long, f_j long, shot_i string, shot_j string, ts_i double, ts_j double, s_i double, s_j double, pair_score double"
    one = spark.createDataFrame([(1, 1, 2, "v1_s1", "v1_s4", 0.0, 5.0, 0.5, 0.5, 0.5), (1, 3, 4, "x", "left", 0.0, None, 0.5, 0.5, 0.5)], pairs)
    two = spark.createDataFrame(
        [(1, 9, 10, "v1_s8", "s", 6.0, 8.0, 0.9, 0.9, 0.9), (1, 11, 12, "v1_s7", "s", 6.0, 9.0, 0.4, 0.4, 0.4), (1, 13, 14, "right", "s", 1.0, 2.0, 1.0, 1.0, 1.0), (1, 15, 16, "left", "s", 1.0, 2.0, 0.1, 0.1, 0.1), (1, 17, 18, "v1_s4", "s", 6.0, 90.0, 1.0, 1.0, 1.0)],
        pairs,
    )
    assert {(r.e0, r.e1, r.e2) for r in chains.chain_join([one, two], 15.0).collect()} == {(1, 2, 12), (3, 4, 16)}


def test_nearest_prefers_the_earlier(spark):
    frames = spark.createDataFrame([(1, 10, 1.0), (1, 11, 3.0), (1, 12, 3.0)], "video_id long, frame_id long, ts double")
    probes = spark.createDataFrame([(1, 1, 2.0), (2, 1, 3.0), (3, 1, 9.0), (4, 1, 0.0), (5, 2, 1.0)], "probe_id long, video_id long, at double")
    assert {r.probe_id: r.frame_id for r in temporal.nearest(probes, frames).collect()} == {1: 10, 2: 11, 3: 12, 4: 10}


def test_band_rejects_a_negative_window(spark):
    with pytest.raises(ValueError, match="negative"):
        temporal.band(spark.range(1), spark.range(1), -1.0)


def test_interval_inference(spark):
    rows = [(1, 1, 0.0), (2, 1, 20.0), (3, 1, 80.0), (4, 2, 7.0), (5, 2, float("nan"))]
    df = spark.createDataFrame(rows, "doc_id long, video_id long, start_sec double")
    assert {(r.doc_id, r.end_sec) for r in temporal.infer_intervals(df).collect()} == {(1, 20.0), (2, 65.0), (3, 125.0), (4, 52.0)}


def test_interval_iou(spark):
    x = [F.lit(float(v)) for v in (0, 2, 1, 3)]
    assert abs(spark.range(1).select(temporal.iou(*x)).first()[0] - 1 / 3) < 1e-9


def test_single_list_keeps_its_scores(spark):
    one = spark.createDataFrame([("q", "a", 1, 0.9), ("q", "a", 2, 0.4)], "query_id string, model string, frame_id long, score double")
    assert {r.frame_id: r.score for r in fusion.srrf(one, ["query_id"]).collect()} == {1: 0.9, 2: 0.4}


def test_adaptive_weight(spark):
    got = spark.range(1).select(fusion.adaptive_weight(F.lit(0.8), F.lit(0.5)).alias("a"), fusion.adaptive_weight(F.lit(1.0), F.lit(0.9)).alias("b")).first()
    assert (got.a, got.b) == (0.4, 0.5)


def test_shot_diversity(spark):
    rows = [("q", 1, "s", 1), ("q", 2, "s", 2), ("q", 3, "s", 3), ("q", 4, "t", 4)]
    df = spark.createDataFrame(rows, "query_id string, frame_id long, shot_id string, rank int")
    got = ranking.diversify(df, ["query_id"], "shot_id", 2, 3).orderBy("place").collect()
    assert [r.frame_id for r in got] == [1, 2, 4]


def test_weighted_sum_of_models(spark):
    rows = [("q", "a", 1, 1.0), ("q", "a", 2, 0.2), ("q", "b", 1, 0.1), ("q", "b", 2, 1.0)]
    df = spark.createDataFrame(rows, "query_id string, model string, frame_id long, score double")
    order = lambda w: [r.frame_id for r in fusion.wsf(df, ["query_id"], ["a", "b"], w, 2).orderBy("rank").collect()]
    assert order({"a": 0.1, "b": 0.9}) == [2, 1] and order({"a": 0.9, "b": 0.1}) == [1, 2]
    assert fusion.model_weights(["a", "b"], {"a": 0.0, "b": 0.0}) == {"a": 0.5, "b": 0.5} == fusion.model_weights(["a", "b"], None)
    assert fusion.model_weights(["a", "b"], {"a": 3.0}) == {"a": 0.75, "b": 0.25}
    with pytest.raises(Exception, match="different frames"):
        fusion.wsf(df.where("not (model = 'b' and frame_id = 2)"), ["query_id"], ["a", "b"], None, 2).collect()
    assert [tuple(r) for r in fusion.aligned(df.where("not (model = 'b' and frame_id = 2)")).collect()] == [("b", 2)]


def test_floor_of_confidence_follows_the_bonus(spark):
    c = lambda v, words, bonus: fusion.modality_confidence(F.lit(v), F.array(*[F.lit(w) for w in words]), bonus)
    got = spark.range(1).select(c(0.0, ["x"], 0.0), c(0.0, ["x"], 0.4), c(0.0, ["x"], 0.9), c(0.3, ["x"], 0.9), c(0.0, [], 0.9)).first()
    assert tuple(got) == (0.5, 0.8, 1.0, 0.3, 0.0)


def test_a_weak_weight_hardly_moves_a_result(spark):
    results = spark.createDataFrame([("q", "visual", 1, 1.0), ("q", "weak", 2, 0.96)], "query_id string, frame_id string, rank int, score double")
    components = spark.createDataFrame([("ocr", "weak", 1.0)], "component string, frame_id string, normalized double")
    evidence = spark.createDataFrame([("weak", 1.0, 1.0, True)], "frame_id string, document_quality double, temporal_weight double, exact_phrase boolean")
    place = lambda w, e: [r.frame_id for r in fusion.evidence_rerank(results, components, {"kis": 1.0, "ocr": w}, e, ["query_id"]).orderBy("place").collect()]
    assert place(0.01, evidence) == ["visual", "weak"] and place(0.5, evidence) == ["weak", "visual"]
    assert place(0.5, evidence.where("false")) == ["visual", "weak"]
    loose = fusion.evidence_rerank(results, components, {"ocr": 0.5}, evidence.withColumn("exact_phrase", F.lit(False)), ["query_id"]).where("place = 1").first()
    assert loose.frame_id == "weak" and loose.score == 1.0


def test_consensus_is_local(spark):
    schema = "query_id string, model string, frame_id string, video_id string, shot_id string, ts double, rank int"
    agree = lambda rows: {r.frame_id: r.consensus for r in fusion.consensus(spark.createDataFrame(rows, schema), ["query_id"], 2).collect()}
    assert agree([("q", "a", "x", "v", None, 10.0, 1), ("q", "b", "y", "v", None, 11.0, 1)]) == {"x": 1.0, "y": 1.0}
    assert agree([("q", "a", "x", "v", "s1", 10.0, 1), ("q", "b", "y", "v", "s2", 200.0, 1)]) == {"x": 0.5, "y": 0.5}
    assert agree([("q", "a", "x", "v", "s1", None, 1), ("q", "b", "y", "v", "s1", 200.0, 1)]) == {"x": 1.0, "y": 1.0}
    assert agree([("q", "a", "x", "v", None, None, 1), ("q", "b", "y", "v", None, None, 1)]) == {"x": 1.0, "y": 1.0}


def test_caps_reserve_frames_and_moments(spark):
    rows = [("q", f"near{k}", "v", "s", float(k) / 10, k) for k in range(1, 9)] + [("q", "later", "v", "s", 60.0, 9), ("q", "kept", "v", "s", 0.0, 10)]
    df = spark.createDataFrame(rows, "query_id string, frame_id string, video_id string, shot_id string, timestamp_sec double, rank int")
    reserved = spark.createDataFrame([("q", "kept")], "query_id string, frame_id string")
    got = lambda cap, r: [x.frame_id for x in ranking.cap_per_video(df, ["query_id"], cap, r).orderBy("place").collect()]
    assert got(3, None) == ["near1", "later", "near2"] and got(3, reserved) == ["kept", "later", "near1"]
    hits = spark.createDataFrame([("q", "a", "f", "v", 1), ("q", "a", "g", "v", 2), ("q", "b", "f", "v", 1), ("q", "b", "h", "v", 2)], "query_id string, model string, frame_id string, video_id string, rank int")
    assert {(r.model, r.frame_id) for r in ranking.branch_reserves(hits, ["query_id"], ["a", "b"]).collect()} == {("a", "f"), ("b", "h")}


def test_common_lines(spark):
    rows = [(k, f"News 24\nline {k}\n\n NEWS  24 ") for k in range(4)] + [(9, "news 24")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (10_000, 0):  # in place, and joined
        assert {(r.doc_id, r.text) for r in quality.drop_common_lines(df, 0.5, most=most).collect()} == {(k, f"line {k}") for k in range(4)}
    alone = df.where("doc_id = 1")
    assert [r.text for r in quality.drop_common_lines(alone, 0.5).collect()] == [rows[1][1]]


def test_jsonl(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"a": 1}\n\n{"a": \n{"a": 2}\n')
    schema = T.StructType([T.StructField("a", T.LongType())])
    rows, corrupt = store.read_jsonl(spark, str(tmp_path / "m.jsonl"), schema)
    assert [r.a for r in rows.collect()] == [1, 2] and [r.sample for r in corrupt.collect()] == ['{"a": ']
    with pytest.raises(Exception, match="corrupt line"):
        store.read_jsonl(spark, str(tmp_path / "m.jsonl"), schema, strict=True)[0].collect()


def test_replace_and_partitions(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    df = spark.createDataFrame([(1, "v"), (2, "w")], "doc_id long, video string")
    assert store.replace(df, path, "doc_id") == 2
    assert store.replace(df.limit(1), path, "doc_id") == 1 and spark.read.parquet(f"{path}.bak").count() == 2
    with pytest.raises(ValueError, match="repeat"):
        store.replace(df.union(df), path, "doc_id")
    assert spark.read.parquet(path).count() == 1
    store.write_partitions(df, f"{path}-p", ["video"])
    store.write_partitions(df.where("video = 'w'").withColumn("doc_id", F.lit(9).cast("long")), f"{path}-p", ["video"])
    assert sorted(r.doc_id for r in store.consolidate(spark, f"{path}-p", "doc_id").collect()) == [1, 9]


def test_repair_and_qrels(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    spark.createDataFrame([('{"a": 1}',), ('{"a": ',), ('{"a": 2}',)], "value string").write.text(path)
    schema = T.StructType([T.StructField("a", T.LongType())])
    assert store.repair(spark, path, schema) == 1 and store.read_jsonl(spark, path, schema)[1].count() == 1
    assert store.repair(spark, path, schema, dry_run=False) == 1
    assert sorted(r.a for r in store.read_jsonl(spark, path, schema, strict=True)[0].collect()) == [1, 2]
    assert spark.read.text(f"{path}.bak").count() == 3
    kind = "query_id string, query string, relevant_frame_ids array<string>, relevant_moments array<struct<video_id string, start_sec double, end_sec double>>"
    good = ("q", "x", ["f"], [("v", 1.0, 1.0)])
    assert store.checked_qrels(spark.createDataFrame([good, ("r", "y", [], [("v", 1.0, 2.0)])], kind)).count() == 2
    for bad, why in ((("q", "z", ["g"], []), "repeated"), (("s", "z", [], []), "no relevance labels"), (("s", "z", [], [("v", 2.0, 1.0)]), "inverted"), (("s", " ", ["f"], []), "no query"), (("", "z", ["f"], []), "no query_id")):
        with pytest.raises(Exception, match=why):
            store.checked_qrels(spark.createDataFrame([good, bad], kind)).collect()


def test_jobs_keep_the_last_state_and_count_failures(spark):
    rows = [("a", "EMBED", "FAILED", 1, 1, "x"), ("a", "EMBED", "FAILED", 2, 2, "y"), ("a", "EMBED", "COMPLETED", 3, 3, None), ("b", "EMBED", "BLOCKED", 9, 4, "z"), ("c", "TEXT", "FAILED", 5, 5, "w")]
    now = store.job_states(spark.createDataFrame(rows, "item_id string, stage string, status string, updated_at long, step long, error string"))
    assert {(r.item_id, r.status, r.attempts) for r in now.collect()} == {("a", "COMPLETED", 2), ("b", "BLOCKED", 0), ("c", "FAILED", 1)}
    assert [r.item_id for r in store.failures(now).collect()] == ["c", "b"] and [r.item_id for r in store.failures(now, "EMBED").collect()] == ["b"]


def test_names_of_images(spark, tmp_path):
    for name in ("v1/a_f0007.jpg", "v1/b.jpg", "v2/c.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    got = store.frames_from_names(store.names_from_files(spark, str(tmp_path))).collect()
    assert {(r.frame_id, r.video_id, r.shot_id, r.frame_index, r.timestamp_sec) for r in got} == {("v1_a_f0007", "v1", "a", 7, None), ("v1_b", "v1", "v1_s0", 0, None)}


def test_path_states(spark):
    paths = spark.createDataFrame([(1, None), (2, "frames\\a"), (3, "../other/a"), (4, "/runs/x/frames/a"), (5, "frames/missing")], "frame_id long, path string")
    files = spark.createDataFrame([("/runs/x/frames/a",)], "file string")
    states = quality.path_states(paths, files, "/runs/x")
    assert {(r.frame_id, r.reason, r.canonical) for r in states.collect()} == {
        (1, "FRAME_PATH_MISSING", False), (2, None, True), (3, "FRAME_PATH_OUTSIDE_EXPERIMENT", False), (4, None, False), (5, "FRAME_FILE_MISSING", False),
    }
    plan = {r.frame_id: r for r in quality.path_migration(states, "/runs/x").collect()}
    assert plan[4].new_path == "frames/a" and plan[4].changed and not plan[2].changed and not any(r.may_apply for r in plan.values())


def test_streaming_upsert_is_idempotent(spark, tmp_path):
    schema = "doc_id long, version long, text string"
    source, target, mark = (f"file://{tmp_path}/{x}" for x in ("in", "out", "mark"))
    for rows in ([(1, 1, "a"), (2, 1, "b")], [(1, 2, "c")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        for _ in range(2):
            ingest.upsert_stream(ingest.stream(spark, source, schema), "doc_id", "version", target, mark).awaitTermination()
    assert {(r.doc_id, r.text) for r in ingest.current(spark, target, "doc_id", "version").collect()} == {(1, "c"), (2, "b")}


def test_streams_drop_repeats_and_count_windows(spark, tmp_path):
    rows = [(1, "a", "2024-01-01 00:00:00"), (1, "a", "2024-01-01 00:00:30"), (2, "b", "2024-01-01 00:20:00"), (3, "a", "2024-01-01 05:00:00")]
    df = spark.createDataFrame(rows, "doc_id long, event_type string, at string").select("doc_id", "event_type", F.to_timestamp("at").alias("at"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = ingest.stream(spark, f"{tmp_path}/in", df.schema)
    for name, out in (("once_rows", ingest.once(stream, "doc_id", "at")), ("window_counts", ingest.counts(stream, "at", "1 hour"))):
        out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.doc_id for r in spark.table("once_rows").collect()) == [1, 2, 3]
    assert {(r.event_type, r.n) for r in spark.table("window_counts").collect()} == {("a", 2), ("b", 1)}  # the last window is still open


def test_config_hash_ignores_order():
    assert store.config_hash({"a": 1, "b": 2}) == store.config_hash({"b": 2, "a": 1})
    plan = {"status": "APPROVED", "config_hash": store.config_hash({"a": 1}), "dataset": "d"}
    assert store.plan_is_current(plan, {"a": 1}, "d") and not store.plan_is_current(plan, {"a": 2}, "d")


def test_a_cluster_must_name_its_shared_folder():
    class Stub:
        master = "spark://host:7077"
        sparkContext = conf = property(lambda self: self)

        def getConf(self):
            return self

        def get(self, *_):
            return None

        getCheckpointDir = get

    with pytest.raises(RuntimeError, match="checkpoint"):
        store.workspace(Stub(), "x")
