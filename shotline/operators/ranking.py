"""Ranks, top-k, diversification and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, by: list, order: list, name: str = "rank") -> DataFrame:
    """1-based rank in each group, ties broken by the order's later keys."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_per(df: DataFrame, by: list, order: list, k: int) -> DataFrame:
    """First k rows of each group with their rank."""
    return ranked(df, by, order).where(F.col("rank") <= k)


def min_max(score: str, by: list, constant: float = 0.0) -> Column:
    """Scores spread over 0..1 in each group; `constant` where all are equal."""
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high - low <= 1e-9, F.lit(constant)).otherwise((F.col(score) - low) / F.greatest(high - low, F.lit(1e-9)))


def max_normalised(score: str, by: list) -> Column:
    """Divided by the group's maximum; unchanged if that isn't positive."""
    top = F.max(score).over(Window.partitionBy(*by))
    return F.when(top > 0, F.col(score) / top).otherwise(F.col(score))


def diversify(df: DataFrame, by: list, group: str, limit: int, k: int) -> DataFrame:
    """At most `limit` rows of a group first, the others behind, in rank order; limit <= 0: as ranked."""
    if limit <= 0:
        return df.where(F.col("rank") <= k).withColumn("place", F.col("rank"))
    later = F.row_number().over(Window.partitionBy(*by, group).orderBy("rank")) > limit
    placed = df.withColumn("later", later)
    placed = placed.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("later", "rank")))
    return placed.where(F.col("place") <= k).drop("later")


def moment_key(seconds: float = 2.0, ts: str = "timestamp_sec") -> Column:
    """What counts as one moment of a video: shot and time bucket, the shot without a time, the frame without either."""
    timed = F.concat_ws(":", F.lit("t"), F.coalesce(F.col("shot_id").cast("string"), F.lit("<unknown>")), F.floor(F.col(ts) / seconds).cast("string"))
    return F.when(F.col(ts).isNotNull(), timed).when(F.col("shot_id").isNotNull(), F.concat(F.lit("s:"), F.col("shot_id").cast("string"))).otherwise(F.concat(F.lit("f:"), F.col("frame_id").cast("string")))


def branch_reserves(hits: DataFrame, by: list, branches: list[str], branch: str = "model") -> DataFrame:
    """(by, video_id, branch, frame_id): of each video and branch the best frame that no earlier branch has reserved.

    `branches` is the order they choose in. A branch looks at as many hits as there
    are branches, so a video's candidates are few and folded in one row.
    """
    order = F.array_position(F.array(*[F.lit(b) for b in branches]), F.col(branch))
    first = ranked(hits.where(F.col(branch).isin(*branches)), [*by, "video_id", branch], ["rank"], "place").where(F.col("place") <= len(branches))
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), "place", F.col(branch).alias("b"), "frame_id")))
    g = first.groupBy(*by, "video_id").agg(rows.alias("rows"))
    taken = F.aggregate(
        "rows", F.slice("rows", 1, 0),
        lambda acc, x: F.when(F.exists(acc, lambda a: (a["b"] == x["b"]) | (a["frame_id"] == x["frame_id"])), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return g.select(*by, "video_id", F.explode(taken).alias("t")).select(*by, "video_id", F.col("t.b").alias(branch), F.col("t.frame_id").alias("frame_id"))


def cap_per_video(df: DataFrame, by: list, cap: int, reserved: DataFrame | None = None, moment_sec: float = 2.0) -> DataFrame:
    """At most `cap` hits of a video: reserved frames first, then first hits of moments that no kept reserved one shows, then the rest, each by rank.

    `reserved` has (by, frame_id).
    """
    d = df.withColumn("moment", moment_key(moment_sec))
    if reserved is None:
        d = d.withColumn("kept", F.lit(False))
    else:
        d = d.join(reserved.select(*by, "frame_id").distinct().withColumn("reserved", F.lit(True)), [*by, "frame_id"], "left")
        place = F.row_number().over(Window.partitionBy(*by, "video_id").orderBy(F.col("reserved").isNull(), "rank"))
        d = d.withColumn("kept", F.col("reserved").isNotNull() & (place <= cap)).drop("reserved")
    group = Window.partitionBy(*by, "video_id", "moment")
    shown = F.max(F.col("kept").cast("int")).over(group) == 1
    first = F.row_number().over(group.orderBy(F.col("kept"), "rank")) == 1
    d = d.withColumn("class", F.when(F.col("kept"), 0).when(~shown & first, 1).otherwise(2))
    d = d.withColumn("place", F.row_number().over(Window.partitionBy(*by, "video_id").orderBy("class", "rank")))
    return d.where(F.col("place") <= cap).drop("moment", "kept", "class")


def witnesses(df: DataFrame, by: list, k: int = 4, moment_sec: float = 2.0) -> DataFrame:
    """First hit of each moment, at most k moments of a video."""
    first = ranked(df.withColumn("moment", moment_key(moment_sec)), [*by, "video_id", "moment"], ["rank"], "n").where("n = 1").drop("n", "moment")
    return ranked(first, [*by, "video_id"], ["rank"], "place").where(F.col("place") <= k)


def display_list(candidates: DataFrame, verdicts: DataFrame, results: DataFrame, by: list, k: int) -> DataFrame:
    """(by, place, frame_id, candidate_id): what a request shows, k rows at most.

    `candidates` (by, candidate_id, video_id, score, selected, evidence: frame ids in
    order) are a short list; they come first, the selected one ahead of supported
    ones ahead of others, by score. Each shows its first frame that its verdict
    (by, candidate_id, verdict, frames) cites, else its first; one row a video, no
    frame twice. Then follow the ranked `results` (by, rank, frame_id).
    """
    c = candidates.join(verdicts, [*by, "candidate_id"], "left")
    cited = F.filter("evidence", lambda f: F.array_contains(F.coalesce(F.col("frames"), F.slice("evidence", 1, 0)), f))
    shown = F.coalesce(F.try_element_at(cited, F.lit(1)), F.try_element_at("evidence", F.lit(1)))
    row = F.struct((~F.col("selected")).alias("a"), (~F.coalesce(F.col("verdict") == "supported", F.lit(False))).alias("b"), (-F.col("score")).alias("c"), "candidate_id", "video_id", shown.alias("frame_id"))
    g = c.groupBy(*by).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    kept = F.aggregate(
        "rows", F.slice("rows", 1, 0),
        lambda acc, x: F.when(x["frame_id"].isNull() | F.exists(acc, lambda y: (y["video_id"] == x["video_id"]) | (y["frame_id"] == x["frame_id"])), acc).otherwise(F.concat(acc, F.array(x))),
    )
    head = g.select(*by, F.posexplode(kept).alias("place", "x")).select(*by, F.lit(0).alias("tail"), F.col("place").cast("long").alias("rank"), F.col("x.frame_id").alias("frame_id"), F.col("x.candidate_id").alias("candidate_id"))
    tail = results.select(*by, F.lit(1).alias("tail"), F.col("rank").cast("long").alias("rank"), "frame_id", F.lit(None).cast(head.schema["candidate_id"].dataType).alias("candidate_id"))
    both = ranked(head.unionByName(tail), [*by, "frame_id"], ["tail", "rank"], "n").where("n = 1")
    return ranked(both, by, ["tail", "rank"], "place").where(F.col("place") <= k).select(*by, "place", "frame_id", "candidate_id")


def first_per_video(df: DataFrame, by: list) -> DataFrame:
    """Each video's first rank."""
    return df.groupBy(*by, "video_id").agg(F.min("rank").alias("first_rank"), F.count("*").alias("n_hits"))


def clamp_k(k: int) -> int:
    """A request's number of results, 1 to 100."""
    return max(1, min(100, int(k)))
