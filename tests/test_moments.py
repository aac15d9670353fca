"""Candidate moments: scenarios, and the whole way against loops."""

from __future__ import annotations

import random

import pytest

from shotline.operators import moments

SCHEMA = "request string, event_index int, rank int, frame_id string, video_id string, shot_id string, ts double, consensus double, best double"
FULL = "request string, rank int, frame_id string, video_id string, ts double"


def rows(lists, **more):
    """Result lists of (frame, video, time) for each event."""
    return [("q", e, r, f, v, more.get("shots", {}).get(f), t, 0.0, more.get("best", {}).get(f, 0.0)) for e, hits in lists.items() for r, (f, v, t) in enumerate(hits, 1)]


def build(spark, lists, full=(), required=(0, 1), context=(2,), candidates=5, pool=20, width=20, target=True, per_event=24, slots=2, **more):
    hits = moments.event_hits(spark.createDataFrame(rows(lists, **more), SCHEMA), ["request"], per_event)
    chains = moments.required_chains(hits, ["request"], list(required), list(context), width)
    f = spark.createDataFrame([("q", r, x, v, t) for r, (x, v, t) in enumerate(full, 1)], FULL)
    scored = moments.scored_moments(moments.with_context(chains, list(context)), f, ["request"], list(required), list(context))
    return moments.selected(scored, ["request"], list(required), list(context), candidates, pool, target, slots).orderBy("candidate").collect()


def test_an_ordered_chain_beats_the_same_hits_out_of_order(spark):
    got = build(spark, {k: [(f"r{k}", "right", 10.0 + 10 * k), (f"w{k}", "wrong", 30.0 - 10 * k)] for k in range(3)}, [("x", "wrong", 15.0), ("y", "right", 20.0)])
    assert [(r.video_id, r.frames) for r in got] == [("right", "r0,r1,r2")]


def test_chains_stay_in_a_video(spark):
    assert build(spark, {0: [("a", "v", 10.0)], 1: [("b", "w", 20.0)], 2: [("c", "v", 30.0)]}) == []


def test_the_first_event_is_not_pruned(spark):
    dead = [(f"d{k}", "v", 100.0 + k) for k in range(25)]
    got = build(spark, {0: [*dead, ("start", "v", 10.0)], 1: [("end", "v", 20.0)], 2: []}, width=5, per_event=32)
    assert [r.frames for r in got] == ["start,end"]


def test_event_numbers_need_not_follow_each_other(spark):
    got = build(spark, {10: [("a", "v", 10.0)], 20: [("b", "v", 20.0)], 30: []}, required=(10, 20), context=(30,))
    assert [r.frames for r in got] == ["a,b"]


def test_gaps_and_spans(spark):
    assert build(spark, {0: [("a", "v", 0.0)], 1: [("b", "v", 61.0)], 2: []}) == []
    assert len(build(spark, {0: [("a", "v", 0.0)], 1: [("b", "v", 60.0)], 2: []})) == 1
    assert build(spark, {0: [("a", "v", 5.0)], 1: [("a", "v", 5.0)], 2: []}) == []


def test_a_slot_for_a_distinctive_context(spark):
    lists = {0: [("g0", "generic", 10.0), ("t0", "target", 10.0)], 1: [("g1", "generic", 20.0), ("t1", "target", 20.0)], 2: [("t2", "target", 30.0), ("g2", "generic", 30.0)]}
    got = build(spark, lists, [("g", "generic", 15.0), ("t", "target", 15.0)], candidates=2)
    assert {(r.video_id, r.source) for r in got} == {("generic", "pool"), ("target", "context_anchor_rescue")}


def test_a_slot_for_a_chain_strong_in_one_branch(spark):
    lists = {0: [("g0", "generic", 10.0), ("t0", "target", 10.0)], 1: [("g1", "generic", 20.0), ("t1", "target", 20.0)], 2: []}
    got = build(spark, lists, [("g", "generic", 15.0)], candidates=2, pool=1, slots=0)
    assert {(r.video_id, r.source) for r in got} == {("generic", "pool"), ("target", "required_chain_rescue")}


def test_a_compact_chain_of_one_shot_is_preferred_by_that_slot(spark):
    lists = {0: [("g0", "generic", 10.0), ("f0", "fragmented", 30.0), ("c0", "compact", 90.0)], 1: [("g1", "generic", 50.0), ("f1", "fragmented", 70.0), ("c1", "compact", 92.0)], 2: []}
    shots = {"g0": "a", "g1": "b", "f0": "c", "f1": "d", "c0": "e", "c1": "e"}
    best = {f: 0.4 if f[0] == "c" else 0.99 for f in shots}
    got = build(spark, lists, candidates=2, pool=1, slots=0, shots=shots, best=best)
    assert [(r.video_id, r.source) for r in got] == [("generic", "pool"), ("compact", "required_chain_rescue")]


def share(rank, pool):
    return 1.0 if pool <= 1 else max(0.0, 1 - (rank - 1) / pool)


def by_loops(lists, full, required, context, width, limit, target):
    """The same by plain loops over one request."""
    hits = {}
    for e, found in lists.items():
        order = list(dict.fromkeys(v for _, v, *_ in found))
        for f, v, t, shot, c, b in found:
            if t is not None and len(hits.setdefault(v, {}).setdefault(e, [])) < 24:
                hits[v][e].append(dict(e=e, f=f, t=t, s=shot, c=c, b=b, r=share(order.index(v) + 1, len(order))))
    videos = list(dict.fromkeys(v for _, v, _ in full))
    near = lambda h, ch: max(x["t"] for x in [h, *ch]) - min(x["t"] for x in [h, *ch]) <= 180
    worth = lambda h: 0.75 * h["r"] + 0.25 * h["c"]
    mean = lambda xs: sum(xs) / len(xs)
    out = []
    for v in sorted(hits):
        beams = [()]
        for k, e in enumerate(required):
            grown = [(*ch, h) for ch in beams for h in hits[v].get(e, []) if all(x["f"] != h["f"] for x in ch) and (not ch or (ch[-1]["t"] < h["t"] <= ch[-1]["t"] + 60 and h["t"] - ch[0]["t"] <= 180))]

            def key(ch, v=v):
                q, a = mean([h["r"] for h in ch]), max((worth(h) for c in context for h in hits[v].get(c, []) if near(h, ch)), default=0.0)
                return (-round(0.8 * q + 0.2 * a, 9), -round(q, 9), ch[-1]["t"] - ch[0]["t"])

            grown.sort(key=key)
            beams = grown if k == 0 and len(required) > 1 else grown[:width]
        for place, need in enumerate(beams, 1):
            ch = list(need)
            for c in context:
                ok = [h for h in hits[v].get(c, []) if all(x["f"] != h["f"] for x in ch) and near(h, ch)]
                if ok:
                    ch.append(max(ok, key=lambda h: h["r"]))
            extra = ch[len(need) :]
            a, b = min(h["t"] for h in ch), max(h["t"] for h in ch)
            m = dict(v=v, place=place, a=a, b=b, f=",".join(h["f"] for h in sorted(ch, key=lambda h: h["e"])), q=mean([h["r"] for h in need]), br=mean([h["b"] for h in need]), k=max(0.0, 1 - (b - a) / 180), kr=max(0.0, 1 - (need[-1]["t"] - need[0]["t"]) / 180))
            shots = [h["s"] for h in need]
            m["sh"] = 1.0 if len(need) == 1 else 0.5 if None in shots else float(len(set(shots)) == 1)
            cover = len(extra) / len(context)
            values = [worth(h) for h in extra]
            m["an"] = max([worth(h) for h in extra if h["e"] < required[0]] or values, default=0.0)
            m["cov"], m["ec"] = cover, len(ch) / (len(required) + len(context))
            g = share(videos.index(v) + 1, len(videos)) if v in videos else 0.0
            m["s"] = 0.42 * m["q"] + 0.23 * cover * (mean(values) if values else 0.0) + 0.18 * mean([h["c"] for h in need]) + 0.07 * g + 0.10 * m["k"]
            out.append(m)
    out.sort(key=lambda m: (-round(m["s"], 9), -round(m["ec"], 9), -round(m["q"], 9), m["v"], m["place"]))
    first = list({m["v"]: m for m in reversed(out)}.values())
    first.sort(key=out.index)
    pool = (first + [m for m in out if m not in first])[:20]
    got = []

    def take(source, cap, most):
        for m in source:
            if len(got) >= most:
                return
            mine = [x for x, _ in got if x["v"] == m["v"]]
            apart = all(x is not m and (max(x["b"], m["b"]) - min(x["a"], m["a"]) > 1e-9 and max(0, min(x["b"], m["b"]) - max(x["a"], m["a"])) < 0.5 * (max(x["b"], m["b"]) - min(x["a"], m["a"]))) for x in mine)
            if len(mine) < cap and apart:
                got.append((m, "pool"))

    def rescue(source, most, why):
        for m in source:
            if len(got) >= most:
                return
            if all(x["v"] != m["v"] for x, _ in got):
                got.append((m, why))

    slots = min(2, limit - 1) if target and len(required) > 1 else 0
    chain_slots = min(1, max(0, limit - slots - 1)) if target and len(required) > 1 else 0
    take(pool, 1, limit - slots - chain_slots)
    take(pool, 2, limit - slots - chain_slots)
    rescue(sorted([m for m in out if m["cov"] > 0], key=lambda m: tuple(-round(z, 9) for z in (0.55 * m["an"] + 0.3 * m["k"] + 0.15 * m["q"], m["an"], m["k"], m["q"]))), min(limit - chain_slots, len(got) + slots), "context_anchor_rescue")
    gap = lambda m: max(0.0, m["br"] - m["q"])
    by_branch = lambda m: (0.35 * m["sh"] + 0.25 * m["kr"] + 0.2 * gap(m) + 0.1 * m["br"] + 0.05 * m["an"] + 0.05 * m["k"], m["sh"], m["kr"], gap(m), m["br"], m["an"], m["k"])
    rescue(sorted(out, key=lambda m: tuple(-round(z, 9) for z in by_branch(m))), min(limit, len(got) + chain_slots), "required_chain_rescue")
    take(pool, 2, limit)
    return [(m["v"], m["f"], why, round(m["s"], 6)) for m, why in got]


@pytest.mark.parametrize(("seed", "required", "context", "target"), [(1, (0, 1), (2,), True), (2, (0, 1), (2,), False), (3, (1, 2), (0, 3), True), (4, (0, 1, 2), (3,), True), (5, (1,), (0,), True)])
def test_the_whole_way_equals_loops(spark, seed, required, context, target):
    random.seed(seed)
    frames = {f"{v}{k}": (v, float(random.randint(0, 240)), random.choice([None, "s", "t"])) for v in "abcdefgh" for k in range(12)}
    lists = {}
    for e in sorted((*required, *context)):
        chosen = random.sample(sorted(frames), 40)
        lists[e] = [(f, frames[f][0], frames[f][1] if random.random() > 0.1 else None, frames[f][2], random.random(), random.random()) for f in chosen]
    full = [(f, frames[f][0], frames[f][1]) for f in random.sample(sorted(frames), 30)]
    data = [("q", e, r, f, v, s, t, c, b) for e, hits in lists.items() for r, (f, v, t, s, c, b) in enumerate(hits, 1)]
    hits = moments.event_hits(spark.createDataFrame(data, SCHEMA), ["request"])
    chains = moments.required_chains(hits, ["request"], list(required), list(context), 6)
    whole = spark.createDataFrame([("q", r, f, v, t) for r, (f, v, t) in enumerate(full, 1)], FULL)
    scored = moments.scored_moments(moments.with_context(chains, list(context)), whole, ["request"], list(required), list(context))
    got = [(r.video_id, r.frames, r.source, round(r.score, 6)) for r in moments.selected(scored, ["request"], list(required), list(context), 5, 20, target).orderBy("candidate").collect()]
    assert got and got == by_loops(lists, full, list(required), list(context), 6, 5, target)
