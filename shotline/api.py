"""Requests as functions of tables: what a service would call, each a lazy DataFrame.

`Tables` names the inputs; vectors of queries come from an embedder (see
`shotline.models`). Errors of a request (no query text, unknown models) are raised
at once; faults of single rows come back as rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotline.operators import chains, fusion, moments, ranking, temporal, text, vector

#: Frames kept of each list before fusion, hits of a text search, and results that evidence reorders.
POOL, EVIDENCE_FIRST, FRAMES_PER_SHOT = 100, 30, 2
#: Weight of a text branch where weights don't follow its hits.
FIXED = 0.3


@dataclass(frozen=True)
class Tables:
    """frames (frame_id, video_id, shot_id, frame_index, timestamp_sec), vectors (model, frame_id, embedding), text_docs (doc_id, source,
    frame_id, text), speech (doc_id, video_id, start_sec, text)."""

    frames: DataFrame
    vectors: DataFrame
    text_docs: DataFrame | None = None
    speech: DataFrame | None = None


def _best(df: DataFrame, by: list, k: int) -> DataFrame:
    return ranking.top_per(df, by, [F.desc(F.round("score", 9)), F.asc("frame_id")], k)


def models(t: Tables) -> list[str]:
    """Names of the models that have vectors."""
    return sorted(r.model for r in t.vectors.select("model").distinct().collect())


def search(t: Tables, queries: DataFrame, k: int = 20, weights: dict[str, float] | None = None, only: list[str] | None = None) -> DataFrame:
    """Text-to-frame search: top-k of each model, score-aware rank fusion, hydration. `queries`: (query_id, model, q)."""
    k = ranking.clamp_k(k)
    v = vector.model_subset(t.vectors, only)
    hits = vector.best(vector.scored_in_blocks(v, queries), vector.pool_size(k, 2)).drop("rank")
    return _best(fusion.srrf(hits, ["query_id"], weights), ["query_id"], k).join(t.frames, "frame_id")


def intelligent_search(
    t: Tables, queries: DataFrame, ocr: tuple[str, ...] = (), asr: tuple[str, ...] = (), confidence: dict[str, float] | None = None, k: int = 20, mode: str = "adaptive", joint: bool = False
) -> DataFrame:
    """Visual and text branches fused: each text branch weighs by how surely it was asked for and how well it hit, its evidence reorders the
    first results, and a shot gives at most two frames before others are used up.

    A branch without hits drops out. Weights and qualities of the branches (three rows at most) come to the driver.
    """
    if mode not in ("adaptive", "fixed"):
        raise ValueError(f"unknown fusion mode {mode}")
    spark, k = t.frames.sparkSession, ranking.clamp_k(k)
    sure = {"ocr": 0.5 if ocr else 0.0, "asr": 0.5 if asr else 0.0} | (confidence or {})
    asked = [(n, ws, (n,)) for n, ws in (("ocr", ocr), ("asr", asr)) if ws and sure[n] > 0]
    if joint and (both := text.joint_request(ocr, asr, sure)):
        asked, sure = [("joint_text", both[0], ("ocr", "asr"))], sure | {"joint_text": both[1]}
    kis = search(t, queries, 100).select("query_id", F.lit("kis").alias("component"), "frame_id", "score")
    weights, parts, evidence = {"kis": 1.0}, [kis], None
    if asked:
        hits = text.keyword_hits(t.text_docs, asked, POOL)
        found = text.keyword_evidence(hits, POOL)
        words = spark.createDataFrame([(n, w) for n, ws, _ in asked for w in ws], "request string, keyword string")
        quality = {r.request: r.hit_quality for r in text.hit_quality(hits, found, words, ["request"]).collect()}
        weights |= {n: min(0.5, max(0.0, round(sure[n] * quality[n], 6))) if mode == "adaptive" else FIXED for n, *_ in asked}
        every = queries.select("query_id").distinct()
        used = found.where(F.col("request").isin(*[n for n, *_ in asked if weights[n] > 0]))
        parts.append(used.crossJoin(every).select("query_id", F.col("request").alias("component"), "frame_id", "score"))  # POOL frames a branch
        evidence = text.evidence_rows(hits).select("frame_id", F.col("quality").alias("document_quality"), F.col("weight").alias("temporal_weight"), "exact_phrase")
    lists = reduce(DataFrame.unionByName, parts)
    fused = _best(fusion.srrf(lists, ["query_id"], weights, branch="component"), ["query_id"], POOL)
    fused = fused.withColumn("score", ranking.max_normalised("score", ["query_id"]))
    if evidence is not None:
        diagnosed = fusion.diagnostics(lists, ["query_id", "component"]).select("query_id", "component", "frame_id", "normalized")
        placed = fusion.evidence_rerank(fused, diagnosed, weights, evidence, ["query_id"], EVIDENCE_FIRST)
        fused = placed.withColumnRenamed("place", "rank")
    return ranking.diversify(fused.join(t.frames, "frame_id"), ["query_id"], "shot_id", FRAMES_PER_SHOT, k)


def detail_two_stage(t: Tables, general: DataFrame, specific: DataFrame, k: int = 300, pool: int = 1000) -> DataFrame:
    """Frames that general sub-queries find, ordered by exact scores of specific ones. Both: (query_id, branch, model, q)."""
    hit = lambda q, n: vector.top_k(t.vectors, q.select(F.concat_ws("|", "query_id", "branch").alias("query_id"), "model", "q"), n)
    split = lambda df: df.select(F.split("query_id", r"\|")[0].alias("query_id"), F.split("query_id", r"\|")[1].alias("branch"), "frame_id", "score")
    every = vector.scored_in_blocks(t.vectors, specific.select(F.concat_ws("|", "query_id", "branch").alias("query_id"), "model", "q"))
    return fusion.two_stage(split(hit(general, pool)), split(every), ["query_id"], pool, k)


def sub_score(t: Tables, queries: DataFrame, frame_id: int) -> DataFrame:
    """Scores of one frame for each query and model, to four digits."""
    one = F.broadcast(t.vectors.where(F.col("frame_id") == frame_id).withColumnRenamed("embedding", "e"))  # a row for each model
    return queries.join(one, "model").select("query_id", "model", F.round(vector.cosine("e", "q"), 4).alias("score"))


def ocr_search(t: Tables, query: str, k: int = 20) -> DataFrame:
    """Frames whose text on screen matches."""
    if not query.strip():
        raise ValueError("the query text is empty")
    docs = t.text_docs.where("source = 'ocr'")
    return text.frame_hits(text.search(docs, query, ranking.clamp_k(k), ("source", "frame_id")), t.frames)


def asr_search(t: Tables, query: str, k: int = 20) -> DataFrame:
    """Frames at which matching speech is heard."""
    if not query.strip():
        raise ValueError("the query text is empty")
    frames = t.frames.select("video_id", "frame_id", F.col("timestamp_sec").alias("ts"))
    mapped = temporal.map_intervals(temporal.infer_intervals(t.speech), frames)
    return text.speech_hits(text.search(t.speech, query), mapped, ranking.clamp_k(k))


def trake_search(events: list[DataFrame], window: float = 15.0, k: int = 100) -> DataFrame:
    """Chains of ordered events in one video: `events` are their hits (frame_id, video_id, shot_id, ts, score)."""
    if len(events) < 2:
        raise ValueError("a chain needs two events or more")
    pairs = [chains.direct_pairs(a, b, window) for a, b in zip(events, events[1:], strict=False)]
    out = chains.chain_join(pairs, window)
    return out.orderBy(F.desc(F.round("score", 9)), *[f"e{x}" for x in range(len(events))]).limit(k)


def vqa_candidates(results: DataFrame, full: DataFrame, required: list[int], context: list[int], candidates: int = moments.CANDIDATES, target: bool = True) -> DataFrame:
    """The moments that are verified for a question: see `shotline.operators.moments`."""
    hits = moments.event_hits(results, ["request"])
    scored = moments.scored_moments(moments.with_context(moments.required_chains(hits, ["request"], required, context), context), full, ["request"], required, context)
    return moments.selected(scored, ["request"], required, context, candidates, target=target)


def temporal_search(t: Tables, similar: DataFrame, seeds: DataFrame) -> DataFrame:
    """Segments around seeds (seed_id, video_id, shot_id, pos) over (.., pos, frame_id, ts, sim): grown both ways, merged, with frames and times."""
    ends = temporal.forward_ends(similar, seeds).select("seed_id", "video_id", "shot_id", F.col("seed_pos").alias("centre"), "end_pos")
    starts = temporal.backward_starts(similar, seeds).select("seed_id", "start_pos")
    merged = temporal.merge_segments(ends.join(starts, "seed_id").select("video_id", "shot_id", "start_pos", "end_pos", "centre"))
    return temporal.gather(merged, similar.select("video_id", "shot_id", "pos", "frame_id", "ts"))


def video_shots(t: Tables, video_id: int) -> DataFrame:
    """Frames of a video by shot, with what is heard and read at them."""
    frames = t.frames.where(F.col("video_id") == video_id)
    speech = t.speech.where(F.col("video_id") == video_id)
    mapped = temporal.map_intervals(temporal.infer_intervals(speech), frames.select("video_id", "frame_id", F.col("timestamp_sec").alias("ts")))
    heard = mapped.select("frame_id", "doc_id").join(speech.select("doc_id", "text"), "doc_id")
    return temporal.shot_listing(frames, heard, t.text_docs.where("source = 'ocr'").select("frame_id", "doc_id", "text"))
