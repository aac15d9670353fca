"""Joins in time, interval inference, adaptive segments, shots and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotline.operators.ranking import ranked


def nearest(probes: DataFrame, frames: DataFrame, width: float = 3600.0) -> DataFrame:
    """Two-sided as-of join: for probes (probe_id, video_id, at) the nearest frame (video_id, frame_id, ts); ties to the earlier.

    Both sides are merged and sorted once per video and time bucket, so a long video
    spreads over many tasks and no pair is emitted: the last frame before and the
    first one behind each probe are carried along, from the buckets around where a
    bucket has none. Only a row for each bucket meets the other buckets of its video.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    f = frames.where("ts is not null").select("video_id", F.col("ts").alias("t"), F.lit(None).cast(probes.schema["probe_id"].dataType).alias("probe_id"), F.struct("ts", "frame_id").alias("frame"))
    p = probes.where("at is not null").select("video_id", F.col("at").alias("t"), "probe_id", F.lit(None).cast(f.schema["frame"].dataType).alias("frame"))
    both = f.unionByName(p).withColumn("bucket", bucket("t"))
    order = [F.col("t"), F.col("probe_id").isNotNull(), F.col("frame.frame_id")]
    back = Window.partitionBy("video_id", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("video_id", "bucket").orderBy(F.col("t"), F.col("probe_id").isNull(), F.col("frame.frame_id")).rowsBetween(0, Window.unboundedFollowing)
    both = both.withColumn("prev", F.last("frame", ignorenulls=True).over(back)).withColumn("next", F.first("frame", ignorenulls=True).over(ahead))
    edges = both.groupBy("video_id", "bucket").agg(F.max("frame").alias("last"), F.min("frame").alias("first"))
    of_video = Window.partitionBy("video_id").orderBy("bucket")
    edges = edges.select(
        "video_id", "bucket", F.last("last", ignorenulls=True).over(of_video.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.first("first", ignorenulls=True).over(of_video.rowsBetween(1, Window.unboundedFollowing)).alias("behind"),
    )
    both = both.where("probe_id is not null").join(edges, ["video_id", "bucket"])
    both = both.withColumn("prev", F.coalesce("prev", "before")).withColumn("next", F.coalesce("next", "behind"))
    later = F.col("prev").isNull() | (F.col("next.ts") - F.col("t") < F.col("t") - F.col("prev.ts"))
    exact = F.col("next.ts") == F.col("t")
    pick = F.when(F.col("next").isNotNull() & (exact | later), F.col("next")).otherwise(F.col("prev"))
    return both.withColumn("pick", pick).where("pick is not null").select("probe_id", "video_id", F.col("pick.frame_id").alias("frame_id"), F.abs(F.col("pick.ts") - F.col("t")).alias("distance"))


def band(probes: DataFrame, frames: DataFrame, window: float) -> DataFrame:
    """Frames with |ts - at| <= window in the probe's video.

    An equi join by time buckets of the window's width (a probe goes to three),
    so that a long video spreads over many tasks.
    """
    if window < 0:
        raise ValueError("the window is negative")
    width = max(window, 1e-6)
    p = probes.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("at") / width) - 1, F.floor(F.col("at") / width) + 1)))
    f = frames.withColumn("bucket", F.floor(F.col("ts") / width))
    joined = p.join(f, ["video_id", "bucket"]).where(F.col("ts").between(F.col("at") - window, F.col("at") + window))
    return joined.drop("bucket")


def decayed(distance: Column, decay: float = 2.0) -> Column:
    return F.exp(-F.abs(distance) / decay)


def infer_intervals(speech: DataFrame, longest: float = 45.0) -> DataFrame:
    """end = min(next start, start + longest), at least start; the last: start + longest; non-finite starts are skipped."""
    ok = speech.where(F.col("start_sec").isNotNull() & ~F.isnan("start_sec") & (F.abs("start_sec") < F.lit(float("inf"))))
    following = F.lead("start_sec").over(Window.partitionBy("video_id").orderBy("start_sec", "doc_id"))
    end = F.least(F.coalesce(following, F.col("start_sec") + longest), F.col("start_sec") + longest)
    return ok.withColumn("end_sec", F.greatest("start_sec", end))


def _spread(df: DataFrame, start: Column, end: Column, width: float) -> DataFrame:
    """Rows once for each time bucket that their interval touches."""
    return df.withColumn("bucket", F.explode(F.sequence(F.floor(start / width), F.floor(end / width))))


def map_intervals(intervals: DataFrame, frames: DataFrame, pad: float = 2.0, decay: float = 2.0, longest: float = 45.0) -> DataFrame:
    """Frames inside an interval weigh 1, within `pad` outside less; an interval without any takes its nearest frame at 1.

    An equi join by time buckets: an interval goes to those it touches, a frame to one.
    """
    i = intervals.withColumn("end_sec", F.greatest("start_sec", F.coalesce("end_sec", F.col("start_sec") + longest)))
    width = max(longest, 1.0)
    spread = _spread(i, F.col("start_sec") - pad, F.col("end_sec") + pad, width)
    near = spread.join(frames.withColumn("bucket", F.floor(F.col("ts") / width)), ["video_id", "bucket"]).where(F.col("ts").between(F.col("start_sec") - pad, F.col("end_sec") + pad))
    off = F.greatest(F.lit(0.0), F.col("start_sec") - F.col("ts"), F.col("ts") - F.col("end_sec"))
    near = near.select("doc_id", "video_id", "frame_id", F.when(off <= 0, F.lit(1.0)).otherwise(decayed(off, decay)).alias("weight"))
    alone = i.join(near, "doc_id", "left_anti")
    closest = nearest(alone.select(F.col("doc_id").alias("probe_id"), "video_id", F.col("start_sec").alias("at")), frames)
    return near.unionByName(closest.select(F.col("probe_id").alias("doc_id"), "video_id", "frame_id", F.lit(1.0).alias("weight")))


def window_search(seeds: DataFrame, frames: DataFrame, window: float, k: int = 30, forward: bool = True) -> DataFrame:
    """Best k frames in (t, t+window], or [t-window, t), of each seed (seed_id, video_id, at); frames have a score."""
    hits = band(seeds, frames, window)
    hits = hits.where((F.col("ts") > F.col("at")) if forward else (F.col("ts") < F.col("at")))
    return ranked(hits, ["seed_id"], [F.desc("score"), F.asc("frame_id")]).where(F.col("rank") <= k)


def forward_ends(frames: DataFrame, seeds: DataFrame, tolerance: int = 3) -> DataFrame:
    """Adaptive scan from each seed (seed_id, video_id, shot_id, pos) over (.., pos, sim).

    A frame at least as similar as the best so far resets the count; after
    `tolerance` frames without one the segment ends that many back.
    """
    return _scan(frames, seeds, tolerance, 1).withColumnRenamed("edge", "end_pos")


def backward_starts(frames: DataFrame, seeds: DataFrame, tolerance: int = 3) -> DataFrame:
    """The same towards earlier frames."""
    return _scan(frames, seeds, tolerance, -1).withColumnRenamed("edge", "start_pos")


def _scan(frames: DataFrame, seeds: DataFrame, tolerance: int, way: int) -> DataFrame:
    s = seeds.select("seed_id", "video_id", "shot_id", F.col("pos").alias("seed_pos"))
    walk = s.join(frames.select("video_id", "shot_id", "pos", "sim"), ["video_id", "shot_id"]).withColumn("step", way * (F.col("pos") - F.col("seed_pos"))).where("step >= 0")
    w = Window.partitionBy("seed_id").orderBy("step")
    best = F.max("sim").over(w.rowsBetween(Window.unboundedPreceding, -1))
    walk = walk.withColumn("record", best.isNull() | (F.col("sim") >= best))
    walk = walk.withColumn("last", F.max(F.when(F.col("record"), F.col("step"))).over(w))
    stop = F.min(F.when(F.col("step") - F.col("last") >= tolerance, F.col("step")))
    ends = walk.groupBy("seed_id", "video_id", "shot_id", "seed_pos").agg(stop.alias("stop"), F.max("step").alias("most"))
    reach = F.when(F.col("stop").isNull(), F.col("most")).otherwise(F.greatest(F.lit(0), F.col("stop") - tolerance))
    return ends.select("seed_id", "video_id", "shot_id", "seed_pos", (F.col("seed_pos") + way * reach).alias("edge"))


def merge_segments(segments: DataFrame, gap: int = 2) -> DataFrame:
    """Segments (video_id, shot_id, start_pos, end_pos, centre) whose start is within `gap` of an earlier end become one."""
    w = Window.partitionBy("video_id", "shot_id").orderBy("start_pos", "centre")
    reach = F.max("end_pos").over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = segments.withColumn("new", F.when(reach.isNull() | (F.col("start_pos") > reach + gap), 1).otherwise(0))
    s = s.withColumn("island", F.sum("new").over(w))
    return s.groupBy("video_id", "shot_id", "island").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.min_by("centre", F.struct("start_pos", "centre")).alias("centre")).drop("island")


def gather(segments: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames of each segment in order, with first and last time."""
    j = segments.join(frames, ["video_id", "shot_id"]).where(F.col("pos").between(F.col("start_pos"), F.col("end_pos")))
    g = j.groupBy("video_id", "shot_id", "start_pos", "end_pos").agg(F.array_sort(F.collect_list(F.struct("pos", "frame_id"))).alias("f"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return g.withColumn("frame_ids", F.array_join(F.col("f.frame_id"), ",")).drop("f")


def middle_frame(frames: DataFrame) -> DataFrame:
    """The frame at n div 2 of each shot, by time."""
    w = Window.partitionBy("shot_id")
    return ranked(frames.withColumn("n", F.count("*").over(w)), ["shot_id"], ["timestamp_sec", "frame_id"]).where(F.expr("rank - 1 = n div 2")).drop("n", "rank")


def shots_from_cuts(cuts: DataFrame, n_frames: int, fps: float) -> DataFrame:
    """Shots (start_frame, end_frame, times) of each video from cut frames (video_id, frame); fps 0: no times."""
    inside = cuts.where(F.col("frame").between(0, n_frames - 2)).select("video_id", "frame").distinct()
    ends = inside.unionByName(cuts.select("video_id").distinct().withColumn("frame", F.lit(n_frames - 1).cast(cuts.schema["frame"].dataType)))
    start = F.coalesce(F.lag("frame").over(Window.partitionBy("video_id").orderBy("frame")) + 1, F.lit(0))
    rate = F.nullif(F.lit(float(fps)), F.lit(0.0))
    s = ends.select("video_id", start.cast("long").alias("start_frame"), F.col("frame").cast("long").alias("end_frame"))
    return s.withColumn("start_sec", F.col("start_frame") / rate).withColumn("end_sec", F.col("end_frame") / rate)


def sample_indices(shots: DataFrame, shares: list[float]) -> DataFrame:
    """Frame indices at shares of each shot's span, halves rounded to even, repeats dropped."""
    if any(not 0 <= p <= 1 for p in shares):
        raise ValueError("a share is outside 0..1")
    span = F.col("end_frame") - F.col("start_frame")
    at = F.array(*[(F.col("start_frame") + F.bround(span * F.lit(float(p)))).cast("long") for p in shares])
    return shots.select("shot_id", F.posexplode(F.array_distinct(at)).alias("place", "frame_index"))


def word_chunks(speech: DataFrame, budget: int = 150) -> DataFrame:
    """Consecutive segments grouped while their words stay within the budget: (video_id, chunk, n_words, n_segments)."""
    n = F.size(F.array_remove(F.split(F.trim("text"), r"\s+"), ""))
    rows = speech.withColumn("w", n).groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("start_sec", "doc_id", "w"))), lambda x: x.w).alias("ws"))
    chunk = F.expr(
        f"""aggregate(ws, cast(array() as array<struct<w:int,n:int>>), (a, w) ->
            if(size(a) > 0 and element_at(a, -1).w + w <= {budget},
               concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).w + w as w, element_at(a, -1).n + 1 as n))),
               concat(a, array(struct(w as w, 1 as n)))))"""
    )
    return rows.select("video_id", F.posexplode(chunk).alias("chunk", "c")).select("video_id", F.col("chunk").cast("long"), F.col("c.w").cast("long").alias("n_words"), F.col("c.n").cast("long").alias("n_segments"))


def speech_windows(spans: DataFrame, longest: float = 30.0, least: float = 0.1) -> DataFrame:
    """Spans (id, start_sec, end_sec) cut every `longest` seconds; a remainder below `least` joins the window before."""
    length = F.col("end_sec") - F.col("start_sec")
    whole = F.floor(length / longest)
    n = F.greatest(F.lit(1), whole + F.when(length - whole * longest >= least, 1).otherwise(0))
    s = spans.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)))
    begin = F.col("start_sec") + F.col("k") * longest
    return s.select("id", F.col("k").alias("window"), begin.alias("from_sec"), F.when(F.col("k") == F.col("n") - 1, F.col("end_sec")).otherwise(begin + longest).alias("to_sec"))


def model_windows(videos: DataFrame, width: int = 100, step: int = 50, edge: int = 25) -> DataFrame:
    """Overlapping windows of each video (video_id, n_frames): (video_id, window, first_frame, last_frame, keep_from, keep_to).

    Frames are padded by repeating the first `edge` times in front, the last as often
    behind and up to a whole step; windows start every `step`. Of a window the
    predictions of its places edge .. edge + step count, for keep_from .. keep_to of
    the video.
    """
    n, rest = F.col("n_frames"), F.col("n_frames") % step
    padded = n + 2 * edge + F.when(rest == 0, 0).otherwise(step - rest)
    w = videos.where("n_frames > 0").withColumn("window", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((padded - width) / step))))
    at = F.col("window") * step - edge
    held = lambda c: F.greatest(F.lit(0), F.least(n - 1, c))
    return w.select("video_id", "window", held(at).alias("first_frame"), held(at + width - 1).alias("last_frame"), (at + edge).alias("keep_from"), held(at + edge + step - 1).alias("keep_to"))


def cut_frames(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Frames (video_id, frame) whose cut score reaches the threshold."""
    return scores.where(F.col("score") >= threshold).select("video_id", "frame")


def neighbours(frames: DataFrame) -> DataFrame:
    """The frames before and behind in the same shot."""
    w = Window.partitionBy("shot_id").orderBy("timestamp_sec", "frame_id")
    return frames.select("frame_id", F.lag("frame_id").over(w).alias("before_id"), F.lead("frame_id").over(w).alias("after_id"))


def shot_listing(frames: DataFrame, heard: DataFrame, read: DataFrame) -> DataFrame:
    """Frames with their shot's bounds and the texts heard and read at them (frame_id, doc_id, text), joined by " | " in order of doc_id."""
    joined = lambda df, name: df.groupBy("frame_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda t: t["text"]), " | ").alias(name))
    of_shot = frames.groupBy("shot_id").agg(F.min("frame_index").alias("start_frame"), F.max("frame_index").alias("end_frame"))
    out = frames.join(joined(heard, "asr"), "frame_id", "left").join(joined(read, "ocr"), "frame_id", "left").join(of_shot, "shot_id")
    return out.select("video_id", "shot_id", "frame_id", F.coalesce("asr", F.lit("")).alias("asr"), F.coalesce("ocr", F.lit("")).alias("ocr"), "start_frame", "end_frame")


def shot_validation(frames: DataFrame, weight: float = 0.3, least_frames: int = 2, threshold: float = 0.15) -> DataFrame:
    """Mean similarity and evenness 1/(1 + largest gap) of each shot (shot_id, ts, sim), mixed and judged."""
    gap = F.col("ts") - F.lag("ts").over(Window.partitionBy("shot_id").orderBy("ts", "frame_id"))
    g = frames.withColumn("gap", gap).groupBy("shot_id").agg(F.avg("sim").alias("mean_sim"), F.coalesce(F.max("gap"), F.lit(0.0)).alias("gap"), F.count("*").alias("n"))
    even = F.when(F.col("gap") <= 0, 1.0).otherwise(1 / (1 + F.col("gap")))
    g = g.withColumn("composite", (1 - weight) * F.col("mean_sim") + weight * even)
    return g.withColumn("valid", (F.col("n") >= least_frames) & (F.col("composite") >= threshold)).drop("gap")


def overlap(moments: DataFrame, speech: DataFrame, pad: float = 2.0, k: int = 8, width: float = 60.0) -> DataFrame:
    """Speech intervals that overlap a padded moment, the nearest to its middle first, at most k.

    Both go to the time buckets they touch; a pair counts in the first one they share.
    """
    a, b = F.col("m_start") - pad, F.col("m_end") + pad
    both = _spread(moments, a, b, width).join(_spread(speech, F.col("start_sec"), F.col("end_sec"), width), ["video_id", "bucket"])
    j = both.where((F.col("start_sec") <= b) & (F.col("end_sec") >= a) & (F.col("bucket") == F.greatest(F.floor(a / width), F.floor(F.col("start_sec") / width)))).drop("bucket")
    off = F.abs((F.col("start_sec") + F.col("end_sec")) / 2 - (F.col("m_start") + F.col("m_end")) / 2)
    return ranked(j.withColumn("off", off), ["moment_id"], ["off", "doc_id"]).where(F.col("rank") <= k)


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Intersection over union of two intervals, 0 if the union is empty."""
    both = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    union = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))
