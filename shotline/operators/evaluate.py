"""Ranking and answer metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotline.functions.scalar import answer as plain_answer
from shotline.functions.scalar import jaccard, tolerant_double
from shotline.operators.temporal import iou


def novelty(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """Results (query_id, rank, item) with gain 1 where they hit a target (query_id, item, target) not seen before."""
    j = results.join(qrels, ["query_id", "item"], "left")
    first = F.row_number().over(Window.partitionBy("query_id", "target").orderBy("rank"))
    j = j.withColumn("new", (F.col("target").isNotNull() & (first == 1)).cast("int"))
    return j.groupBy("query_id", "rank", "item").agg(F.max("new").alias("gain"), F.sum("new").alias("targets"))


def discounts(rank: str = "rank") -> tuple[Column, Column]:
    """What a hit at a rank counts: reciprocally, and by the logarithm."""
    return 1 / F.col(rank), 1 / F.log2(F.col(rank) + 1)


def metrics(results: DataFrame, qrels: DataFrame, k: int = 10, candidates: int = 50) -> DataFrame:
    """recall@k, candidate recall, nDCG@k with novelty gain, MRR of each query with targets."""
    n = qrels.groupBy("query_id").agg(F.countDistinct("target").alias("n"))
    g = novelty(results, qrels)
    a = g.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= k, F.col("targets")).otherwise(0)).alias("found"),
        F.sum(F.when(F.col("rank") <= candidates, F.col("targets")).otherwise(0)).alias("found_all"),
        F.sum(F.when(F.col("rank") <= k, F.col("gain") * discounts()[1]).otherwise(0.0)).alias("dcg"),
        F.min(F.when(F.col("gain") > 0, F.col("rank"))).alias("first"),
    )
    ideal = F.expr(f"aggregate(sequence(1, least(n, {k})), 0d, (s, i) -> s + 1 / log2(i + 1))")
    j = n.join(a, "query_id", "left")
    return j.select(
        "query_id", (F.coalesce("found", F.lit(0)) / F.col("n")).alias("recall"), (F.coalesce("found_all", F.lit(0)) / F.col("n")).alias("candidate_recall"),
        (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
    )


def route_scores(routes: DataFrame) -> DataFrame:
    """Precision and recall of predicted against expected modalities (arrays)."""
    both = F.size(F.array_intersect("predicted", "expected"))
    return routes.select(
        "query_id",
        F.when(F.size("predicted") > 0, both / F.size("predicted")).otherwise((F.size("expected") == 0).cast("double")).alias("precision"),
        F.when(F.size("expected") > 0, both / F.size("expected")).otherwise(F.lit(1.0)).alias("recall"),
    )


def answer_scores(pairs: DataFrame) -> DataFrame:
    """(pair_id, em, f1): exact match and the best multiset token F1 of (pair_id, answer, references), compared as plain answers.

    References that are empty as answers don't count; both are null without any.
    """
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    refs = F.filter(F.transform("references", lambda r: plain_answer(r)), lambda r: r != "")
    p = pairs.select("pair_id", plain_answer(F.coalesce("answer", F.lit(""))).alias("p"), refs.alias("refs")).withColumn("a", words(F.col("p")))
    count = lambda arr, w: F.size(F.filter(arr, lambda v: v == w))
    shared = lambda r: F.aggregate(F.transform(F.array_distinct("a"), lambda w: F.least(count(F.col("a"), w), count(r, w))), F.lit(0), lambda s, n: s + n)
    f1 = lambda r: F.when(F.size("a") == 0, F.lit(0.0)).otherwise(2 * shared(r) / (F.size("a") + F.size(r)))
    some = F.size("refs") > 0
    return p.select("pair_id", F.when(some, F.array_contains("refs", F.col("p")).cast("double")).alias("em"), F.when(some, F.array_max(F.transform("refs", lambda r: f1(words(r))))).alias("f1"))


def video_recall(targets: DataFrame, candidates: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, recall): share of a query's target videos among its first k candidates (query_id, rank, video_id)."""
    n = targets.distinct().groupBy("query_id").agg(F.count("*").alias("n"))
    hit = targets.distinct().join(candidates.where(F.col("rank") <= k).select("query_id", "video_id").distinct(), ["query_id", "video_id"]).groupBy("query_id").agg(F.count("*").alias("hit"))
    return n.join(hit, "query_id", "left").select("query_id", (F.coalesce("hit", F.lit(0)) / F.col("n")).alias("recall"))


def evidence_accuracy(relevant: DataFrame, moments: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, accuracy): 1 if a cited frame is relevant; for queries with moments alone, if one lies in a moment of its video.

    `relevant` (query_id, frame_id), `moments` (query_id, video_id, start_sec,
    end_sec), `evidence` (query_id, frame_id, video_id, ts).
    """
    framed, timed = relevant.select("query_id").distinct(), moments.select("query_id").distinct()
    by_frame = evidence.join(relevant, ["query_id", "frame_id"], "left_semi").select("query_id").distinct()
    inside = evidence.join(moments, ["query_id", "video_id"]).where(F.col("ts").between(F.col("start_sec"), F.col("end_sec"))).select("query_id").distinct()
    score = lambda asked, met: asked.join(met.withColumn("met", F.lit(1.0)), "query_id", "left").select("query_id", F.coalesce("met", F.lit(0.0)).alias("accuracy"))
    return score(framed, by_frame).unionByName(score(timed.join(framed, "query_id", "left_anti"), inside))


def span_of(start: Column, end: Column, times: Column) -> Column:
    """A prediction's interval; a point takes its evidence's span, or half a second around the first time (its own without any)."""
    lo, hi = F.array_min(times), F.array_max(times)
    at = F.coalesce(F.try_element_at(times, F.lit(1)), start)
    point = F.when((F.size(times) >= 2) & (hi > lo), F.struct(lo.alias("a"), hi.alias("b"))).otherwise(F.struct(F.greatest(F.lit(0.0), at - 0.5).alias("a"), (at + 0.5).alias("b")))
    return F.when(end > start, F.struct(start.alias("a"), end.alias("b"))).otherwise(point)


def temporal_scores(results: DataFrame, moments: DataFrame, speech: DataFrame) -> DataFrame:
    """(query_id, best, top1, r1_50, r1_70) of queries with moments: the best IoU, and the first result's, against 0.5 and 0.7.

    A result (query_id, rank, frame_id, video_id, ts) stands for the speech intervals
    among its evidence (`speech`: query_id, frame_id, seg_start, seg_end), else for
    a second on either side of its time.
    """
    r = results.join(speech, ["query_id", "frame_id"], "left")
    a, b = F.coalesce("seg_start", F.col("ts") - 1), F.coalesce("seg_end", F.col("ts") + 1)
    j = r.withColumn("a", a).withColumn("b", b).join(moments, ["query_id", "video_id"])
    j = j.withColumn("iou", iou(F.col("a"), F.col("b"), F.col("start_sec"), F.col("end_sec")))
    g = j.groupBy("query_id").agg(F.max("iou").alias("best"), F.max(F.when(F.col("rank") == 1, F.col("iou"))).alias("top1"))
    out = moments.select("query_id").distinct().join(g, "query_id", "left")
    out = out.select("query_id", F.coalesce("best", F.lit(0.0)).alias("best"), F.coalesce("top1", F.lit(0.0)).alias("top1"))
    return out.withColumn("r1_50", (F.col("top1") >= 0.5).cast("double")).withColumn("r1_70", (F.col("top1") >= 0.7).cast("double"))


def latency(runs: DataFrame, by: list) -> DataFrame:
    """Mean and linearly interpolated percentiles."""
    return runs.groupBy(*by).agg(F.avg("ms").alias("mean_ms"), F.expr("percentile(ms, 0.5)").alias("p50_ms"), F.expr("percentile(ms, 0.95)").alias("p95_ms"), F.count("ms").alias("n_evaluated"))


def stability(runs: DataFrame) -> DataFrame:
    """(query_id, answers, videos, evidence, overall) of queries with two runs or more: (query_id, run, status, answer, video, evidence: ids).

    Answers and videos are stable (1.0) if all runs agree, the status included;
    evidence is the mean Jaccard of all pairs of runs that cite something, null
    without such a pair; overall is the mean of the first two.
    """
    said = F.struct(F.coalesce("status", F.lit("")).alias("s"), plain_answer(F.coalesce("answer", F.lit(""))).alias("a"))
    shown = F.struct(F.coalesce("status", F.lit("")).alias("s"), F.coalesce("video", F.lit("")).alias("v"))
    g = runs.groupBy("query_id").agg(
        F.countDistinct("run").alias("n"), F.size(F.collect_set(said)).alias("answers"), F.size(F.collect_set(shown)).alias("videos"),
        F.transform(F.array_sort(F.collect_list(F.struct("run", "evidence"))), lambda r: F.array_distinct(r["evidence"])).alias("sets"),
    ).where("n >= 2")
    pairs = F.flatten(F.transform("sets", lambda a, i: F.transform(F.slice("sets", i + 2, F.size("sets")), lambda b: jaccard(a, b))))
    some = F.filter(pairs, lambda v: v.isNotNull())
    mean = F.aggregate(some, F.lit(0.0), lambda s, v: s + v) / F.size(some)
    one = lambda c: (F.col(c) == 1).cast("double")
    return g.select("query_id", one("answers").alias("answers"), one("videos").alias("videos"), F.when(F.size(some) > 0, mean).alias("evidence"), ((one("answers") + one("videos")) / 2).alias("overall"))


def usage_totals(calls: DataFrame, by: list) -> DataFrame:
    """What model calls of each group used: operations, http_requests, rate_limited, wait_ms, prompt_tokens, completion_tokens, total_tokens, cost.

    `calls` has (by, logical_calls, request_count, wait_ms, rate_limited, the tokens
    and cost) as reported; what isn't a number counts nothing, requests never less
    than nothing.
    """
    whole = lambda c: F.coalesce(F.col(c).cast("string").try_cast("long"), F.lit(0))
    real = lambda c: F.coalesce(tolerant_double(F.col(c).cast("string")), F.lit(0.0))
    sums = [F.sum(whole(c)).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")]
    return calls.groupBy(*by).agg(
        F.sum("logical_calls").alias("operations"), F.sum(F.greatest(F.lit(0), whole("request_count"))).alias("http_requests"),
        F.sum(F.coalesce("rate_limited", F.lit(False)).cast("long")).alias("rate_limited"), F.round(F.sum(real("wait_ms")), 3).alias("wait_ms"), *sums, F.sum(real("cost")).alias("cost"),
    )


# What each preset of the evaluation switches.
ABLATIONS = {
    "kis": {"enable_kis": True, "enable_ocr": False, "enable_asr": False},
    "kis_ocr": {"enable_kis": True, "enable_ocr": True, "enable_asr": False},
    "kis_asr": {"enable_kis": True, "enable_ocr": False, "enable_asr": True},
    "all_fixed": {"fusion_mode": "fixed"},
    "all_adaptive": {"fusion_mode": "adaptive"},
    "all_no_llm": {"fusion_mode": "adaptive", "use_llm": False},
    "asr_nearest": {"enable_ocr": False, "temporal_asr": False},
    "all_no_rerank": {"fusion_mode": "adaptive", "use_reranker": False, "use_evidence_reranker": False},
    "joint_text": {"fusion_mode": "adaptive", "text_search_mode": "joint"},
}
