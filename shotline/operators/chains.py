"""Ordered event chains: pairs, chain joins and a beam over required events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotline.operators.ranking import ranked
from shotline.operators.temporal import band, window_search


def direct_pairs(first: DataFrame, second: DataFrame, window: float) -> DataFrame:
    """Hits (frame_id, video_id, ts, score, and maybe shot_id) of two events in one video with 0 < dt <= window."""
    with_shots = "shot_id" in first.columns and "shot_id" in second.columns
    seeds = first.select(F.col("frame_id").alias("f_i"), "video_id", F.col("ts").alias("at"), F.col("score").alias("s_i"), *([F.col("shot_id").alias("shot_i")] if with_shots else []))
    j = band(seeds, second, window).where(F.col("ts") > F.col("at"))
    shots = ["shot_i", F.col("shot_id").alias("shot_j")] if with_shots else []
    return j.select("video_id", "f_i", F.col("frame_id").alias("f_j"), F.col("at").alias("ts_i"), F.col("ts").alias("ts_j"), "s_i", F.col("score").alias("s_j"), ((F.col("s_i") + F.col("score")) / 2).alias("pair_score"), *shots)


def shot_number(shot: Column) -> Column:
    """The last integer of a shot's id, null without one."""
    return F.try_element_at(F.regexp_extract_all(shot.cast("string"), F.lit(r"(\d+)"), F.lit(1)), F.lit(-1)).cast("long")


def bidirectional_pairs(first: DataFrame, second: DataFrame, all_first: DataFrame, all_second: DataFrame, window: float, k: int, per_seed: int = 30) -> DataFrame:
    """Direct pairs, and each side's hits extended by the best frames around; of equal pairs the best (then the earlier branch) stays."""
    cols = ["video_id", "f_i", "f_j", "ts_i", "ts_j", "s_i", "s_j", "pair_score", "branch"]
    direct = direct_pairs(first, second, window).withColumn("branch", F.lit(0))
    a = first.select(F.col("frame_id").alias("seed_id"), "video_id", F.col("ts").alias("at"), F.col("score").alias("s_seed"))
    fwd = window_search(a, all_second, window, per_seed, True)
    fwd = fwd.select("video_id", F.col("seed_id").alias("f_i"), F.col("frame_id").alias("f_j"), F.col("at").alias("ts_i"), F.col("ts").alias("ts_j"), F.col("s_seed").alias("s_i"), F.col("score").alias("s_j"), ((F.col("s_seed") + F.col("score")) / 2).alias("pair_score"), F.lit(1).alias("branch"))
    b = second.select(F.col("frame_id").alias("seed_id"), "video_id", F.col("ts").alias("at"), F.col("score").alias("s_seed"))
    bwd = window_search(b, all_first, window, per_seed, False)
    bwd = bwd.select("video_id", F.col("frame_id").alias("f_i"), F.col("seed_id").alias("f_j"), F.col("ts").alias("ts_i"), F.col("at").alias("ts_j"), F.col("score").alias("s_i"), F.col("s_seed").alias("s_j"), ((F.col("s_seed") + F.col("score")) / 2).alias("pair_score"), F.lit(2).alias("branch"))
    every = reduce(DataFrame.unionByName, [x.select(*cols) for x in (direct, fwd, bwd)]).where("ts_i < ts_j")
    once = ranked(every, ["f_i", "f_j"], [F.desc("pair_score"), "branch"], "n").where("n = 1").drop("n")
    return once.orderBy(F.desc("pair_score"), "f_i", "f_j").limit(k)


def chain_join(pairs: list[DataFrame], window: float, shot_distance: int = 3) -> DataFrame:
    """Each pair of the first step followed by the single best next pair of the same video, near in shots and time; unmatched chains go.

    `pairs[k]` has (video_id, f_i, f_j, shot_i, shot_j, ts_i, ts_j, s_i, s_j,
    pair_score) for events k and k+1. A pair continues a chain if its first frame's
    shot number is at most `shot_distance` from that of the last one's (equal ids
    without numbers; no condition where one has no shot), and its second frame lies
    within the window behind it (no condition where one has no time). Equal pairs go
    by their frames. Timed pairs meet by time buckets.
    """
    w0 = pairs[0]
    chains = w0.select("video_id", F.col("f_i").alias("e0"), F.col("f_j").alias("e1"), F.col("s_i").alias("s0"), F.col("s_j").alias("s1"), F.col("shot_j").alias("last_shot"), F.col("ts_j").alias("last_ts"))
    width = max(window, 1e-6)
    for k, nxt in enumerate(pairs[1:], start=2):
        n = nxt.select("video_id", F.col("f_i").alias("n_i"), F.col("shot_i").alias("n_shot"), F.col("f_j").alias(f"e{k}"), F.col("shot_j").alias("next_shot"), F.col("ts_j").alias("n_ts"), F.col("s_j").alias(f"s{k}"), "pair_score")
        at = F.floor(F.col("last_ts") / width)
        timed = chains.where("last_ts is not null").withColumn("bucket", F.explode(F.sequence(at, at + 1)))
        timed = timed.join(n.where("n_ts is not null").withColumn("bucket", F.floor(F.col("n_ts") / width)), ["video_id", "bucket"]).drop("bucket")
        timed = timed.where((F.col("n_ts") > F.col("last_ts")) & (F.col("n_ts") <= F.col("last_ts") + window))
        free = chains.where("last_ts is null").join(n, "video_id").unionByName(chains.where("last_ts is not null").join(n.where("n_ts is null"), "video_id"))
        a, b = shot_number(F.col("last_shot")), shot_number(F.col("n_shot"))
        apart = F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) > shot_distance).otherwise(F.coalesce(F.col("last_shot") != F.col("n_shot"), F.lit(False)))
        j = timed.unionByName(free.select(*timed.columns)).where(~apart)
        events = [f"e{x}" for x in range(k)]
        best = ranked(j, ["video_id", *events], [F.desc("pair_score"), "n_i", f"e{k}"], "n").where("n = 1")
        chains = best.select("video_id", *events, f"e{k}", *[f"s{x}" for x in range(k + 1)], F.col("next_shot").alias("last_shot"), F.col("n_ts").alias("last_ts"))
    return chain_scores(chains, len(pairs) + 1)


def chain_scores(chains: DataFrame, n_events: int) -> DataFrame:
    """(video_id, e0 .., score): the mean over events of each score's share of the event's maximum (1 if that is nothing), each chain once.

    The maxima are one row, combined on the map side.
    """
    top = chains.agg(*[F.max(f"s{x}").alias(f"m{x}") for x in range(n_events)])
    most = lambda x: F.when(F.col(f"m{x}") > 1e-12, F.col(f"m{x}")).otherwise(F.lit(1.0))
    shares = [F.col(f"s{x}") / most(x) for x in range(n_events)]
    events = [f"e{x}" for x in range(n_events)]
    scored = chains.crossJoin(F.broadcast(top)).withColumn("score", reduce(lambda a, b: a + b, shares) / n_events)
    return scored.groupBy("video_id", *events).agg(F.max("score").alias("score"))


def evidence_frames(candidates: DataFrame, anchors: DataFrame, frames: DataFrame, most: int = 24, padding: float = 2.0) -> DataFrame:
    """(candidate_id, place, frame_id): frames that show a candidate, `most` at most.

    `candidates` has (candidate_id, video_id, start_sec, end_sec), `anchors`
    (candidate_id, priority, frame_id, shot_id, ts, kind: "anchor", "answer" or
    "global"), `frames` (video_id, shot_id, frame_id, ts). First come the anchors by
    priority, then the frames right before and behind answer-bearing ones in their
    shot and the padded window, then the global hit, then always the frame of the
    window that is farthest from all chosen (the earlier of two). Without any
    priority the frame nearest the middle begins. A window holds few frames: it is
    folded in one row.
    """
    inside = frames.join(candidates, "video_id").where(F.col("ts").between(F.col("start_sec") - padding, F.col("end_sec") + padding))
    window = inside.groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct("ts", "frame_id"))).alias("window"), F.first((F.col("start_sec") + F.col("end_sec")) / 2).alias("middle"))
    w = Window.partitionBy("video_id").orderBy("ts", "frame_id")
    around = frames.select("video_id", "frame_id", *[f(F.struct("frame_id", "shot_id", "ts")).over(w).alias(n) for f, n in ((F.lag, "b"), (F.lead, "a"))])
    answer = anchors.where("kind = 'answer'").join(candidates, "candidate_id").join(around, ["video_id", "frame_id"])
    sides = answer.select("candidate_id", "priority", "shot_id", "start_sec", "end_sec", F.posexplode(F.array("b", "a")).alias("side", "n")).where("n is not null")
    sides = sides.where((F.col("n.shot_id") == F.col("shot_id")) & F.col("n.ts").between(F.col("start_sec") - padding, F.col("end_sec") + padding))
    first = anchors.select("candidate_id", F.when(F.col("kind") == "global", 2).otherwise(0).alias("o"), "priority", F.lit(0).alias("side"), "ts", "frame_id")
    first = first.unionByName(sides.select("candidate_id", F.lit(1).alias("o"), "priority", "side", F.col("n.ts").alias("ts"), F.col("n.frame_id").alias("frame_id")))
    first = ranked(first, ["candidate_id", "frame_id"], ["o", "priority", "side"], "n").where("n = 1")
    head = first.groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct("o", "priority", "side", "ts", "frame_id"))).alias("head"))
    row = lambda h: F.struct(h["ts"].alias("ts"), h["frame_id"].alias("frame_id"))
    j = candidates.select("candidate_id").join(window, "candidate_id", "left").join(head, "candidate_id", "left")
    none = F.slice("window", 1, 0)
    j = j.withColumn("chosen", F.coalesce(F.transform("head", row), none)).withColumn("window", F.coalesce("window", F.slice("chosen", 1, 0)))
    near = F.array_min(F.transform("window", lambda p: F.struct(F.abs(p["ts"] - F.col("middle")).alias("d"), p.alias("p"))))["p"]
    j = j.withColumn("chosen", F.when((F.size("chosen") == 0) & (F.size("window") > 0), F.array(near)).otherwise(F.coalesce("chosen", none)))

    def add(acc: Column, _: Column) -> Column:
        free = F.filter("window", lambda p: ~F.exists(acc, lambda c: c["frame_id"] == p["frame_id"]))
        far = F.transform(free, lambda p: F.struct((-F.array_min(F.transform(acc, lambda c: F.abs(c["ts"] - p["ts"])))).alias("d"), p.alias("p")))
        return F.when((F.size(acc) >= most) | (F.size(free) == 0), acc).otherwise(F.concat(acc, F.array(F.array_min(far)["p"])))

    picked = F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.col("chosen"), add)
    return j.select("candidate_id", F.posexplode(picked).alias("place", "p")).select("candidate_id", (F.col("place") + 1).alias("place"), F.col("p.frame_id").alias("frame_id"))


def chronological(cited: DataFrame) -> DataFrame:
    """Whether each answer's cited events are strictly later one after another."""
    w = Window.partitionBy("answer_id").orderBy("event_index")
    return cited.withColumn("ok", F.coalesce(F.col("ts") > F.lag("ts").over(w), F.lit(True))).groupBy("answer_id").agg(F.bool_and("ok").alias("chronological"))
