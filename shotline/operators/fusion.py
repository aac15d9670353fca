"""Fusion of ranked lists and scores, and reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotline.operators import tiles
from shotline.operators.ranking import max_normalised, min_max, ranked, top_per


def _weight(weights: dict[str, float], branch: str) -> Column:
    out = F.lit(1.0)
    for name, w in weights.items():
        out = F.when(F.col(branch) == name, F.lit(float(w))).otherwise(out)
    return out


def srrf(hits: DataFrame, by: list, weights: dict[str, float] | None = None, k: float = 60, beta: float = 0.5, branch: str = "model") -> DataFrame:
    """Score-aware reciprocal rank fusion of (by, branch, frame_id, score); a single list keeps its scores."""
    group = [*by, branch]
    lists = Window.partitionBy(*by)
    h = ranked(hits, group, [F.desc("score"), F.asc("frame_id")]).withColumn("spread", min_max("score", group))
    h = h.withColumn("part", _weight(weights or {}, branch) * ((1 - beta) / (k + F.col("rank")) + beta * F.col("spread")))
    h = h.withColumn("lists", F.size(F.collect_set(branch).over(lists)))
    fused = h.groupBy(*by, "frame_id").agg(F.sum("part").alias("fused"), F.max("lists").alias("lists"), F.max("score").alias("raw"))
    return fused.select(*by, "frame_id", F.when(F.col("lists") == 1, F.col("raw")).otherwise(F.col("fused")).alias("score"))


def _shares(scores: DataFrame, by: list, branch: str) -> DataFrame:
    """Each score as a share of its branch's maximum (1 instead of a maximum up to 1e-12); the maxima are few and joined back."""
    top = scores.groupBy(*by, branch).agg(F.max("score").alias("top"))
    return scores.join(top, [*by, branch]).withColumn("part", F.col("score") / F.when(F.col("top") <= 1e-12, 1.0).otherwise(F.col("top")))


def model_weights(models: list[str], weights: dict[str, float] | None) -> dict[str, float]:
    """Weights of all models, summing to 1: those given, 1 for others; equal ones if none is given or they sum to nothing."""
    chosen = {m: float((weights or {}).get(m, 1.0)) for m in models}
    total = sum(chosen.values())
    return {m: w / total for m, w in chosen.items()} if weights and total > 1e-12 else {m: 1 / len(models) for m in models}


def wsf(scores: DataFrame, by: list, models: list[str], weights: dict[str, float] | None, k: int, branch: str = "model") -> DataFrame:
    """Weighted sum of scores of the models named, each model's divided by its maximum; models must have scored the same frames.

    A frame that a model lacks fails the query when its row is read.
    """
    parts = _shares(scores, by, branch).withColumn("part", F.col("part") * _weight(model_weights(models, weights), branch))
    fused = parts.groupBy(*by, "frame_id").agg(F.sum("part").alias("score"), F.count("*").alias("n"))
    checked = F.when(F.col("n") == len(models), F.col("score")).otherwise(F.raise_error(F.concat(F.lit("models have different frames: "), F.col("frame_id").cast("string"))))
    return top_per(fused.select(*by, "frame_id", checked.alias("score")), by, [F.desc(F.round("score", 9)), F.asc("frame_id")], k)


def wsf_search(vectors: DataFrame, queries: DataFrame, models: list[str], weights: dict[str, float] | None, k: int) -> DataFrame:
    """The same over all scores of `queries`, which are summed where they are made instead of being shuffled."""
    fused = tiles.weighted(vectors, queries, model_weights(models, weights), k)
    return top_per(fused, ["query_id"], [F.desc(F.round("score", 9)), F.asc("frame_id")], k)


def aligned(scores: DataFrame, branch: str = "model") -> DataFrame:
    """Frames that a model lacks: (model, frame_id); empty if all models have the same. The models' names are one row."""
    models = scores.agg(F.collect_set(branch).alias("models"))
    held = scores.groupBy("frame_id").agg(F.collect_set(branch).alias("held"))
    return held.crossJoin(F.broadcast(models)).select(F.explode(F.array_except("models", "held")).alias(branch), "frame_id")


def two_stage(general: DataFrame, specific: DataFrame, by: list, pool: int, k: int) -> DataFrame:
    """Stage one fuses general sub-queries' hits (missing: 0) to a pool; stage two the specific scores of that pool."""
    first = top_per(weighted_sum(general, by), by, [F.desc(F.round("score", 9)), F.asc("frame_id")], pool).select(*by, "frame_id")
    second = weighted_sum(specific.join(first, [*by, "frame_id"], "left_semi"), by)
    return top_per(second, by, [F.desc(F.round("score", 9)), F.asc("frame_id")], k)


def weighted_sum(hits: DataFrame, by: list, branch: str = "branch") -> DataFrame:
    """Mean over branches of max-normalised scores (missing: 0); the raw score if there is one branch."""
    n = hits.groupBy(*by).agg(F.countDistinct(branch).alias("n")) if by else hits.agg(F.countDistinct(branch).alias("n"))
    summed = _shares(hits, by, branch).groupBy(*by, "frame_id").agg(F.sum("part").alias("part"), F.max("score").alias("raw"))
    joined = summed.join(n, by) if by else summed.crossJoin(F.broadcast(n))  # one row
    return joined.select(*by, "frame_id", F.when(F.col("n") == 1, F.col("raw")).otherwise(F.col("part") / F.col("n")).alias("score"))


def adaptive_weight(confidence: Column, quality: Column, most: float = 0.5) -> Column:
    """clamp(confidence x hit quality, 0, most), six digits."""
    return F.round(F.least(F.lit(most), F.greatest(F.lit(0.0), confidence * quality)), 6)


def modality_confidence(confidence: Column, keywords: Column, bonus: Column | float = 0.0, floor: float = 0.5) -> Column:
    """Clamped to 0..1; where keywords are present and nothing was said at least `floor`, or twice the modality's bonus, 1 at most."""
    held = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(confidence, F.lit(0.0))))
    extra = bonus if isinstance(bonus, Column) else F.lit(float(bonus))
    raised = F.least(F.lit(1.0), F.greatest(F.lit(floor), F.coalesce(extra, F.lit(0.0)) * 2))
    return F.when((F.size(keywords) > 0) & (held <= 0), raised).otherwise(held)


def diagnostics(hits: DataFrame, by: list) -> DataFrame:
    """Rank, raw and min-max score in each component (equal scores: 1)."""
    return ranked(hits, by, [F.desc("score"), F.asc("frame_id")]).withColumn("normalized", min_max("score", by, 1.0))


def evidence_rerank(
    results: DataFrame, components: DataFrame, weights: dict[str, float], evidence: DataFrame, by: list, first: int = 30, main: str = "kis", gain: float = 0.20, bonus: float = 0.02, loose: float = 0.8
) -> DataFrame:
    """The first results gain from what auxiliary components say and the evidence of it; the others follow as ranked.

    `components` has (component, frame_id, normalized), `evidence` (frame_id,
    document_quality, temporal_weight, exact_phrase); either may lack columns of
    `by` and then holds for all requests. An auxiliary score is normalized x its
    component's weight, of weights above 0. A result with auxiliary scores and
    evidence gains `gain` x the best auxiliary score x the best evidence (quality x
    temporal weight, x `loose` without the exact phrase), and `bonus` x the sum of
    auxiliary scores x min(1, their number / 3). Scores are divided by the largest
    at last. A request without any evidence stays as it was.
    """
    on = lambda df: [*[c for c in by if c in df.columns], "frame_id"]
    used = {c: w for c, w in weights.items() if c != main and w > 0}
    aux = components.where(F.col("component").isin(*used)).withColumn("aux", F.col("normalized") * _weight(used, "component"))
    aux = aux.groupBy(*on(components)).agg(F.max("aux").alias("best_aux"), F.sum("aux").alias("all_aux"), F.count("*").alias("n_aux"))
    worth = F.col("document_quality") * F.col("temporal_weight") * F.when(F.col("exact_phrase"), 1.0).otherwise(loose)
    said = evidence.groupBy(*on(evidence)).agg(F.max(worth).alias("worth"))
    r = results.join(aux, on(components), "left").join(said, on(evidence), "left").withColumn("head", F.col("rank") <= first)
    gained = gain * F.col("best_aux") * F.col("worth") + bonus * F.least(F.lit(1.0), F.col("n_aux") / 3) * F.col("all_aux")
    r = r.withColumn("new", F.when(F.col("head") & F.col("worth").isNotNull() & F.col("best_aux").isNotNull(), F.col("score") + gained).otherwise(F.col("score")))
    place = Window.partitionBy(*by).orderBy(F.desc("head"), F.when(F.col("head"), -F.round("new", 9)).otherwise(0.0), "rank")
    r = r.withColumn("place", F.row_number().over(place)).withColumn("final", max_normalised("new", by))
    if by and set(by) <= set(evidence.columns):
        r = r.join(evidence.select(*by).distinct().withColumn("known", F.lit(True)), by, "left")
    else:
        r = r.crossJoin(F.broadcast(evidence.limit(1).agg(F.when(F.count("*") > 0, True).alias("known"))))  # one row
    known = F.coalesce("known", F.lit(False))
    return r.select(*by, "frame_id", F.when(known, F.col("place")).otherwise(F.col("rank")).alias("place"), F.when(known, F.col("final")).otherwise(F.col("score")).alias("score"))


def cross_encoder_blend(results: DataFrame, by: list, model_score: str = "model_score", share: float = 0.6) -> DataFrame:
    """share x model + rest x min-max base; rows without a model score go last as ranked."""
    w = Window.partitionBy(*by)
    low, span = F.min("score").over(w), F.max("score").over(w) - F.min("score").over(w)
    base = (F.col("score") - low) / F.when(span <= 0, 1.0).otherwise(span)
    return results.withColumn("blended", share * F.col(model_score) + (1 - share) * base)


def window_bonus(similarity: Column, ocr: Column, asr: Column, top_ocr: Column, top_asr: Column, w_ocr: float = 0.3, w_asr: float = 0.3, least: float = 15.0) -> Column:
    """Cosine plus text scores over max(their maximum, least), weighted."""
    o = F.coalesce(ocr, F.lit(0.0)) / F.greatest(top_ocr, F.lit(least))
    a = F.coalesce(asr, F.lit(0.0)) / F.greatest(top_asr, F.lit(least))
    return (similarity + w_ocr * o + w_asr * a) / (1 + w_ocr + w_asr)


def rank_score(pool: int | Column, rank: str = "rank") -> Column:
    """1 for the first, falling to 0 behind the pool; 1 in a pool of one."""
    n = pool if isinstance(pool, Column) else F.lit(float(pool))
    return F.when(n <= 1, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - (F.col(rank) - 1) / n))


def consensus(hits: DataFrame, by: list, branches: int, branch: str = "model", window: float = 3.0) -> DataFrame:
    """Union of branches: 0.8 x best rank score + 0.2 x consensus, with both parts.

    `hits` has (by, branch, frame_id, video_id, shot_id, ts, rank); a branch's rank
    scores are relative to its own hits. Consensus is the sum over branches of the
    best rank score in the frame's local moment, divided by `branches` (those
    without hits included), 1 at most.
    """
    size = hits.groupBy(*by, branch).agg(F.count("*").alias("size"))
    h = hits.join(size, [*by, branch]).withColumn("rs", rank_score(F.col("size")))
    frame = ["frame_id", "video_id", "shot_id", "ts"]
    best = h.groupBy(*by, *frame).agg(F.max("rs").alias("best"))
    near = local_moments(best.select(*by, *frame), h.select(*by, *frame, branch, "rs"), by, window)
    per = near.groupBy(*by, "frame_id", branch).agg(F.max("rs").alias("m")).groupBy(*by, "frame_id").agg(F.sum("m").alias("m"))
    agreed = F.least(F.lit(1.0), F.col("m") / branches)
    out = best.join(per, [*by, "frame_id"])
    return out.select(*by, *frame, F.col("best").alias("best_rank_score"), agreed.alias("consensus"), (0.8 * F.col("best") + 0.2 * agreed).alias("score"))


def local_moments(left: DataFrame, right: DataFrame, by: list, window: float = 3.0) -> DataFrame:
    """Rows of `right` that show the moment of a frame of `left`, of the same video: (by, frame_id, other_id, and what else `right` has).

    Three disjoint joins: times within the window where both have one; the same
    shot where one has none; the video alone where neither has a time or a shot.
    """
    own = {"frame_id", "video_id", "shot_id", "ts", *by}
    more = [c for c in right.columns if c not in own]
    b = right.withColumnRenamed("frame_id", "other_id").withColumnRenamed("ts", "ts_b").withColumnRenamed("shot_id", "shot_b")
    keys = [*by, "video_id"]
    cols = [*by, "frame_id", "other_id", *more]
    bucket = lambda c: F.floor(F.col(c) / max(window, 1e-6))
    timed = left.where("ts is not null").withColumn("bucket", F.explode(F.sequence(bucket("ts") - 1, bucket("ts") + 1)))
    timed = timed.join(b.where("ts_b is not null").withColumn("bucket", bucket("ts_b")), [*keys, "bucket"]).where(F.abs(F.col("ts") - F.col("ts_b")) <= window)
    shots = left.where("shot_id is not null").join(b.where("shot_b is not null"), keys).where("shot_id = shot_b and (ts is null or ts_b is null)")
    bare = left.where("ts is null and shot_id is null").join(b.where("ts_b is null and shot_b is null"), keys)
    return timed.select(*cols).unionByName(shots.select(*cols)).unionByName(bare.select(*cols))


def auxiliary_merge(visual: DataFrame, text: DataFrame, by: list, gain: float = 0.2, branch: str = "source") -> DataFrame:
    """Rank scores of the visual list plus gain x those of each text list (by `branch`); a list's pool is its own length."""
    sized = lambda df, keys: df.join(df.groupBy(*keys).agg(F.count("*").alias("size")), keys)
    seen = sized(visual, by).select(*by, "frame_id", rank_score(F.col("size")).alias("score"), F.lit(1).alias("visual"))
    extra = sized(text, [*by, branch]).select(*by, "frame_id", (gain * rank_score(F.col("size"))).alias("score"), F.lit(0).alias("visual"))
    out = seen.unionByName(extra).groupBy(*by, "frame_id").agg(F.sum("score").alias("score"), F.max("visual").alias("visual"))
    return out.select(*by, "frame_id", "score", (F.col("visual") == 1).alias("is_visual"))


def auxiliary_merge_shared(visual: DataFrame, text: DataFrame, by: list, gain: float = 0.2, branch: str = "source") -> DataFrame:
    """The same with text lists (branch, frame_id, rank) that all requests of `visual` share: a frame's gains are summed before they meet the requests."""
    size = text.groupBy(branch).agg(F.count("*").alias("size"))
    bonus = text.join(size, branch).groupBy("frame_id").agg(F.sum(gain * rank_score(F.col("size"))).alias("bonus"))
    n = visual.groupBy(*by).agg(F.count("*").alias("size"))
    seen = visual.join(n, by).select(*by, "frame_id", rank_score(F.col("size")).alias("score"))
    # Every request gets every frame of the lists, which searches have cut to a few hundred.
    more = n.select(*by).crossJoin(F.broadcast(bonus)).select(*by, "frame_id", F.col("bonus").alias("score"))
    return seen.unionByName(more).groupBy(*by, "frame_id").agg(F.sum("score").alias("score"))
