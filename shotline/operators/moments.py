"""Candidate moments: chains of event hits, their scores, and the few that are verified.

A request has required events (in order) and optional context events. Its hits are
ranked lists, one for each event: bounded, as searches cut them. All that follows
is bounded too: 24 hits of a video and event, 20 chains of a video, a pool of 20
moments and at most five candidates of a request, so the greedy steps are folds
over short arrays in one projection, without Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotline.operators.fusion import rank_score
from shotline.operators.ranking import ranked

PER_EVENT, WIDTH, POOL, CANDIDATES = 24, 20, 20, 5
GAP, SPAN, NEAR = 60.0, 180.0, 10.0
CONTEXT_SLOTS, CHAIN_SLOTS = 2, 1
OVERLAP = 0.5
#: A hit in a chain.
HIT = ("event_index", "pos", "frame_id", "shot_id", "ts", "rank_score", "consensus", "best")


def event_hits(results: DataFrame, by: list, per_event: int = PER_EVENT) -> DataFrame:
    """Hits of each video and event, the first `per_event` with a time, with the video's rank score.

    `results`: (by, event_index, rank, frame_id, video_id, shot_id, ts, consensus,
    best). A video ranks by its first hit in the event's list, and lends all its
    hits there the rank score of that place among the list's videos.
    """
    first = results.groupBy(*by, "event_index", "video_id").agg(F.min("rank").alias("first"))
    places = ranked(first, [*by, "event_index"], ["first"], "video_rank")
    n = first.groupBy(*by, "event_index").agg(F.count("*").alias("videos"))
    scored = places.join(n, [*by, "event_index"]).select(*by, "event_index", "video_id", rank_score(F.col("videos"), "video_rank").alias("rank_score"))
    once = ranked(results.where("ts is not null"), [*by, "event_index", "frame_id"], ["rank"], "n").where("n = 1").drop("n")
    hits = ranked(once, [*by, "video_id", "event_index"], ["rank"], "pos").where(F.col("pos") <= per_event)
    return hits.join(scored, [*by, "event_index", "video_id"]).select(*by, "video_id", *HIT)


def _hit() -> Column:
    return F.struct(*HIT)


def _mean(chain: Column, field: str) -> Column:
    return F.aggregate(F.transform(chain, lambda h: h[field]), F.lit(0.0), lambda a, x: a + x) / F.size(chain)


def _extent(chain: Column) -> Column:
    return F.array_max(F.transform(chain, lambda h: h["ts"])) - F.array_min(F.transform(chain, lambda h: h["ts"]))


def _fits(hit: Column, chain: Column, span: float) -> Column:
    """Whether a context hit and the chain lie within the span."""
    times = F.transform(F.concat(chain, F.array(hit)), lambda h: h["ts"])
    return F.array_max(times) - F.array_min(times) <= span


def _context_quality(hit: Column) -> Column:
    return 0.75 * hit["rank_score"] + 0.25 * hit["consensus"]


def ordered_pairs(hits: DataFrame, by: list, required: list[int], gap: float = GAP, span: float = SPAN) -> DataFrame:
    """Every chain of required events without pruning: strictly later, within gap and span, no frame twice (by, video_id, chain)."""
    keys = [*by, "video_id"]
    chains = hits.where(F.col("event_index") == required[0]).select(*keys, F.array(_hit()).alias("chain"))
    for event in required[1:]:
        chains = _extended(chains, hits, keys, event, gap, span)
    return chains.select(*keys, F.transform("chain", lambda h: h["frame_id"]).alias("frames"))


def _extended(chains: DataFrame, hits: DataFrame, keys: list, event: int, gap: float, span: float) -> DataFrame:
    more = hits.where(F.col("event_index") == event).select(*keys, _hit().alias("hit"))
    j = chains.join(more, keys)
    last, first, at = F.element_at("chain", -1)["ts"], F.col("chain")[0]["ts"], F.col("hit.ts")
    ok = (at > last) & (at <= last + gap) & (at - first <= span) & ~F.exists("chain", lambda h: h["frame_id"] == F.col("hit.frame_id"))
    return j.where(ok).withColumn("chain", F.concat("chain", F.array("hit"))).drop("hit")


def required_chains(hits: DataFrame, by: list, required: list[int], context: list[int], width: int = WIDTH, gap: float = GAP, span: float = SPAN) -> DataFrame:
    """The best `width` chains of required events of each video, with its context hits: (by, video_id, place, chain, around).

    Chains go by .8 x mean rank score + .2 x the best context hit that fits, then
    by the former, then the shorter; equal ones by how they came about. The first of
    several events isn't pruned.
    """
    keys = [*by, "video_id"]
    rows = hits.where(F.col("event_index").isin(*context)) if context else hits.where(F.lit(False))
    around = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(_hit())).alias("around"))
    chains = hits.where(F.col("event_index") == required[0]).select(*keys, F.array(_hit()).alias("chain"), F.lit(1).alias("place"))
    chains = chains.join(around, keys, "left").withColumn("around", F.coalesce("around", F.slice("chain", 1, 0)))
    for k, event in enumerate(required):
        if k:
            chains = _extended(chains, hits, keys, event, gap, span)
        quality = _mean(F.col("chain"), "rank_score")
        best = F.coalesce(F.array_max(F.transform(F.filter("around", lambda h: _fits(h, F.col("chain"), span)), _context_quality)), F.lit(0.0))
        order = [F.desc(F.round(0.8 * quality + 0.2 * best, 9)), F.desc(F.round(quality, 9)), F.element_at("chain", -1)["ts"] - F.col("chain")[0]["ts"], "place", F.element_at("chain", -1)["pos"]]
        chains = ranked(chains, keys, order, "new").drop("place").withColumnRenamed("new", "place")
        if k or len(required) == 1:
            chains = chains.where(F.col("place") <= width)
    return chains.select(*keys, "place", "chain", "around")


def with_context(chains: DataFrame, context: list[int], span: float = SPAN) -> DataFrame:
    """Each chain with at most one hit of each context event: the best that fits what the chain holds by then and isn't in it."""
    c = chains
    for event in context:
        free = F.filter("around", lambda h: (h["event_index"] == event) & ~F.exists("chain", lambda x: x["frame_id"] == h["frame_id"]) & _fits(h, F.col("chain"), span))  # noqa: B023
        best = F.array_max(F.transform(free, lambda h: F.struct(h["rank_score"].alias("a"), (-h["pos"]).alias("b"), h.alias("hit"))))["hit"]
        c = c.withColumn("best", best).withColumn("chain", F.when(F.col("best").isNotNull(), F.concat("chain", F.array("best"))).otherwise(F.col("chain"))).drop("best")
    return c


def scored_moments(chains: DataFrame, full: DataFrame, by: list, required: list[int], context: list[int], span: float = SPAN) -> DataFrame:
    """Complete moments with all their scores; `full` are the whole request's results (by, rank, frame_id, video_id, ts).

    score = .42 chain + .23 context + .18 consensus + .07 global rank + .10 compactness.
    """
    keys = [*by, "video_id"]
    is_required = lambda h: h["event_index"].isin(*required)
    need, extra = F.filter("chain", is_required), F.filter("chain", lambda h: ~is_required(h))
    compact = lambda extent: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - extent / max(1.0, span)))
    m = chains.withColumn("need", need).withColumn("extra", extra)
    m = m.withColumn("start_sec", F.array_min(F.transform("chain", lambda h: h["ts"]))).withColumn("end_sec", F.array_max(F.transform("chain", lambda h: h["ts"])))
    m = m.withColumn("chain_score", _mean(F.col("need"), "rank_score")).withColumn("consensus", _mean(F.col("need"), "consensus")).withColumn("branch_score", _mean(F.col("need"), "best"))
    shots, known = F.array_distinct(F.transform("need", lambda h: h["shot_id"])), ~F.exists("need", lambda h: h["shot_id"].isNull())
    m = m.withColumn("shot_coherence", F.when(F.size("need") <= 1, 1.0).when(~known, 0.5).when(F.size(shots) == 1, 1.0).otherwise(0.0))
    m = m.withColumn("compactness", compact(F.col("end_sec") - F.col("start_sec"))).withColumn("required_compactness", compact(_extent(F.col("need"))))
    if context:
        values = F.transform("extra", _context_quality)
        ahead = F.transform(F.filter("extra", lambda h: h["event_index"] < required[0]), _context_quality)
        m = m.withColumn("coverage", F.size("extra") / len(context))
        m = m.withColumn("context_quality", F.when(F.size("extra") > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size("extra")).otherwise(0.0))
        m = m.withColumn("anchor", F.coalesce(F.array_max(ahead), F.array_max(values), F.lit(0.0))).withColumn("context_part", F.col("coverage") * F.col("context_quality"))
    else:
        m = reduce(lambda d, c: d.withColumn(c, F.lit(1.0)), ("coverage", "context_quality", "anchor", "context_part"), m)
    first = full.groupBy(*keys).agg(F.min("rank").alias("first"))
    places = ranked(first, by, ["first"], "video_rank").join(first.groupBy(*by).agg(F.count("*").alias("videos")), by)
    m = m.join(places.select(*keys, rank_score(F.col("videos"), "video_rank").alias("global_score")), keys, "left").withColumn("global_score", F.coalesce("global_score", F.lit(0.0)))
    score = 0.42 * F.col("chain_score") + 0.23 * F.col("context_part") + 0.18 * F.col("consensus") + 0.07 * F.col("global_score") + 0.10 * F.col("compactness")
    m = m.withColumn("event_coverage", F.size("chain") / (len(required) + len(context))).withColumn("score", score)
    frames = F.array_join(F.transform(F.array_sort("chain"), lambda h: h["frame_id"].cast("string")), ",")
    return m.withColumn("frames", frames).drop("need", "extra", "around", "chain")


def _best_first() -> list:
    return [F.desc(F.round("score", 9)), F.desc(F.round("event_coverage", 9)), F.desc(F.round("chain_score", 9)), "video_id", "place"]


def pooled(moments: DataFrame, by: list, pool: int = POOL) -> DataFrame:
    """The best moment of each video first, then others, `pool` of a request: with pool_place."""
    m = ranked(ranked(moments, by, _best_first(), "best"), [*by, "video_id"], ["best"], "of_video")
    return ranked(m, by, [F.col("of_video") > 1, "best"], "pool_place").where(F.col("pool_place") <= pool).drop("best", "of_video")


def rescue_keys() -> tuple[list[Column], list[Column]]:
    """What the slots for a distinctive context, and for a chain strong in one branch, are given by."""
    gap = F.greatest(F.lit(0.0), F.col("branch_score") - F.col("chain_score"))
    context = [0.55 * F.col("anchor") + 0.30 * F.col("compactness") + 0.15 * F.col("chain_score"), F.col("anchor"), F.col("compactness"), F.col("chain_score")]
    chain = 0.35 * F.col("shot_coherence") + 0.25 * F.col("required_compactness") + 0.20 * gap + 0.10 * F.col("branch_score") + 0.05 * F.col("anchor") + 0.05 * F.col("compactness")
    return context, [chain, F.col("shot_coherence"), F.col("required_compactness"), gap, F.col("branch_score"), F.col("anchor"), F.col("compactness")]


def _row(place: str) -> Column:
    return F.struct(F.col(place).alias("at"), "video_id", F.col("place").alias("chain_place"), "start_sec", "end_sec", "frames", F.round("score", 9).alias("score"))


def _same(a: Column, b: Column) -> Column:
    return (a["video_id"] == b["video_id"]) & (a["chain_place"] == b["chain_place"])


def _overlaps(a: Column, b: Column) -> Column:
    both = F.greatest(F.lit(0.0), F.least(a["end_sec"], b["end_sec"]) - F.greatest(a["start_sec"], b["start_sec"]))
    union = F.greatest(a["end_sec"], b["end_sec"]) - F.least(a["start_sec"], b["start_sec"])
    points = F.abs(a["start_sec"] - b["start_sec"]) <= 1e-9
    return F.when(union <= 1e-9, points).otherwise(both / union >= OVERLAP)


def _take(chosen: Column, source: Column, cap: int, limit: int, why: str) -> Column:
    """`chosen` and what of `source` doesn't overlap one of its video by half, `cap` a video, up to `limit`."""

    def add(acc: Column, x: Column) -> Column:
        mine = F.filter(acc, lambda a: a["m"]["video_id"] == x["video_id"])
        no = (F.size(acc) >= limit) | (F.size(mine) >= cap) | F.exists(mine, lambda a: _same(a["m"], x) | _overlaps(a["m"], x))
        return F.when(no, acc).otherwise(F.concat(acc, F.array(F.struct(F.lit(why).alias("source"), x.alias("m")))))

    return F.aggregate(source, chosen, add)


def _rescue(chosen: Column, source: Column, most: Column, why: str) -> Column:
    """The same with the first of `source` whose video isn't there yet, up to `most`."""

    def add(acc: Column, x: Column) -> Column:
        no = (F.size(acc) >= most) | F.exists(acc, lambda a: a["m"]["video_id"] == x["video_id"])
        return F.when(no, acc).otherwise(F.concat(acc, F.array(F.struct(F.lit(why).alias("source"), x.alias("m")))))

    return F.aggregate(source, chosen, add)


def selected(
    moments: DataFrame, by: list, required: list[int], context: list[int], candidates: int = CANDIDATES, pool: int = POOL, target: bool = True, context_slots: int = CONTEXT_SLOTS, chain_slots: int = CHAIN_SLOTS
) -> DataFrame:
    """(by, candidate, source, video_id, chain_place, frames, score): the candidates that are verified.

    Pooled moments first, one a video, then two, none that overlaps another of its
    video by half. For a request with an unknown target and several required events
    slots are kept for distinctive contexts, if there are any, and for a chain that
    is strong in one branch, each for a video not chosen yet. What stays free
    goes to the pool.
    """
    two = target and len(required) >= 2
    for_context = min(context_slots, max(0, candidates - 1)) if two and context else 0
    for_chain = min(chain_slots, max(0, candidates - for_context - 1)) if two else 0
    standard = candidates - for_context - for_chain
    # One exchange by request: every order is a rank over it, and what the slots choose from is one row.
    m = ranked(ranked(moments, by, _best_first(), "best"), [*by, "video_id"], ["best"], "of_video")
    m = ranked(m, by, [F.col("of_video") > 1, "best"], "pool_place")
    reserves = {"by_context": (F.col("coverage") > 0, rescue_keys()[0], for_context), "by_chain": (F.lit(True), rescue_keys()[1], for_chain)}
    for name, (able, keys, _) in reserves.items():
        # The best able moment of each video, and its place among them.
        m = ranked(m, [*by, "video_id"], [~able, *(F.desc(F.round(k, 9)) for k in keys), "best"], f"{name}_n")
        m = ranked(m, by, [~able | (F.col(f"{name}_n") > 1), *(F.desc(F.round(k, 9)) for k in keys), "best"], f"{name}_at")
    held = lambda on, place: F.array_sort(F.collect_list(F.when(on, _row(place))))
    lists = [held(F.col("pool_place") <= pool, "pool_place").alias("pool")]
    for name, (able, _, slots) in reserves.items():
        # As many videos as may be taken already, and the slots.
        lists.append(held(able & (F.col(f"{name}_n") == 1) & (F.col(f"{name}_at") <= candidates + slots), f"{name}_at").alias(name))
    rows = m.groupBy(*by).agg(*lists)
    none = F.slice("pool", 1, 0)
    got = F.transform(none, lambda x: F.struct(F.lit("pool").alias("source"), x.alias("m")))
    got = rows.withColumn("got", _take(_take(got, F.col("pool"), 1, standard, "pool"), F.col("pool"), 2, standard, "pool"))
    if for_context:
        most = F.least(F.lit(candidates - for_chain), F.size("got") + for_context)
        got = got.withColumn("most", most).withColumn("got", _rescue(F.col("got"), F.col("by_context"), F.col("most"), "context_anchor_rescue"))
    if for_chain:
        most = F.least(F.lit(candidates), F.size("got") + for_chain)
        got = got.withColumn("most", most).withColumn("got", _rescue(F.col("got"), F.col("by_chain"), F.col("most"), "required_chain_rescue"))
    got = got.withColumn("got", _take(F.col("got"), F.col("pool"), 2, candidates, "pool"))
    out = got.select(*by, F.posexplode("got").alias("k", "g"))
    return out.select(*by, (F.col("k") + 1).alias("candidate"), "g.source", "g.m.video_id", "g.m.chain_place", "g.m.frames", "g.m.score")
