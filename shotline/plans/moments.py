"""Candidate moments of ordered events: beams, context, scores, selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotline.operators import moments
from shotline.plans.registry import query
from shotline.sources import fixtures as fx

r6 = lambda c: F.round(c, 6)
BY, REQUIRED, CONTEXT = ["request"], [0, 1], [2]
#: Seconds between events and of a moment, as the fixture's clock runs in days.
GAP, SPAN = 172_800.0, 604_800.0

# The oracle: hits, pairs and beams of two required events and one of context, as joins and windows over plain rows.
HITS = f"""{fx.RESULTS_SQL}, vr as (select request, event_index, video_id, row_number() over (partition by request, event_index order by min(rank)) as vr, count(*) over (partition by request, event_index) as n from results group by request, event_index, video_id),
hits as (select * from (select r.*, row_number() over (partition by r.request, video_id, event_index order by rank) as pos, case when n <= 1 then 1.0::double else greatest(0, 1 - (vr - 1) / n) end as rs from results r join vr using (request, event_index, video_id) where ts is not null) where pos <= 24)"""
PAIRS = f"""{HITS}, one as (select * from hits where event_index = 0), two as (select * from hits where event_index = 1), ctx as (select *, 0.75 * rs + 0.25 * consensus as q from hits where event_index = 2),
anchor1 as (select a.request, a.frame_id, max(q) as q from one a join ctx using (request, video_id) where abs(ctx.ts - a.ts) <= {SPAN} group by all),
first as (select a.*, row_number() over (partition by a.request, video_id order by round(0.8 * rs + 0.2 * coalesce(q, 0), 9) desc, round(rs, 9) desc, pos) as place from one a left join anchor1 using (request, frame_id)),
pairs as (select a.request, a.video_id, a.frame_id as f0, b.frame_id as f1, a.ts as t0, b.ts as t1, a.rs as r0, b.rs as r1, a.consensus as c0, b.consensus as c1, a.best as b0, b.best as b1, a.shot_id as s0, b.shot_id as s1, a.place as p0, b.pos as p1
  from first a join two b on a.request = b.request and a.video_id = b.video_id and b.ts > a.ts and b.ts <= a.ts + {GAP} and b.ts - a.ts <= {SPAN} and a.frame_id <> b.frame_id)"""
BEAM = f"""{PAIRS}, anchor2 as (select p.request, f0, f1, max(q) as q from pairs p join ctx c on p.request = c.request and p.video_id = c.video_id and greatest(c.ts, t1) - least(c.ts, t0) <= {SPAN} group by all),
beam as (select * from (select p.*, (r0 + r1) / 2 as quality, row_number() over (partition by p.request, video_id order by round(0.8 * (r0 + r1) / 2 + 0.2 * coalesce(q, 0), 9) desc, round((r0 + r1) / 2, 9) desc, t1 - t0, p0, p1) as place from pairs p left join anchor2 using (request, f0, f1)) where place <= 20)"""
CONTEXTED = f"""{BEAM}, cx as (select * from (select b.request, b.video_id, b.place, c.frame_id as f2, c.ts as t2, c.q, row_number() over (partition by b.request, b.video_id, b.place order by c.rs desc, c.pos) as n
  from beam b join ctx c on b.request = c.request and b.video_id = c.video_id and greatest(c.ts, t1) - least(c.ts, t0) <= {SPAN} and c.frame_id not in (f0, f1)) where n = 1),
full_chain as (select b.*, f2, t2, q, f0 || ',' || f1 || coalesce(',' || f2, '') as frames, least(t0, coalesce(t2, t0)) as start_sec, greatest(t1, coalesce(t2, t1)) as end_sec from beam b left join cx using (request, video_id, place))"""
SCORED = f"""{CONTEXTED}, wv as (select request, video_id, row_number() over (partition by request order by min(rank)) as vr, count(*) over (partition by request) as n from whole group by request, video_id),
m0 as (select f.*, quality as chain_score, (c0 + c1) / 2 as consensus, (b0 + b1) / 2 as branch_score, case when s0 is null or s1 is null then 0.5::double when s0 = s1 then 1 else 0 end as shot_coherence,
  greatest(0, least(1, 1 - (end_sec - start_sec) / {SPAN})) as compactness, greatest(0, least(1, 1 - (t1 - t0) / {SPAN})) as required_compactness, case when f2 is null then 0.0::double else 1 end as coverage,
  coalesce(q, 0.0::double) as anchor, case when wv.n is null then 0.0::double when wv.n <= 1 then 1.0::double else greatest(0, 1 - (wv.vr - 1) / wv.n) end as global_score from full_chain f left join wv using (request, video_id)),
m as (select *, (2 + coverage) / 3 as event_coverage, 0.42 * chain_score + 0.23 * coverage * anchor + 0.18 * consensus + 0.07 * global_score + 0.10 * compactness as score from m0)"""
POOLED = f"""{SCORED}, bf as (select *, row_number() over (partition by request order by round(score, 9) desc, round(event_coverage, 9) desc, round(chain_score, 9) desc, video_id, place) as best from m),
pv as (select *, row_number() over (partition by request, video_id order by best) as of_video from bf), pool as (select * from (select *, row_number() over (partition by request order by of_video > 1, best) as pp from pv) where pp <= 20)"""
# Selection as a walk over numbered steps: the pool once a video, twice a video, the two reserves, the pool again.
GAP_SQL = "greatest(0, branch_score - chain_score)"
SELECTED = f"""{POOLED}, rc as (select *, row_number() over (partition by request order by k1 desc, k2 desc, k3 desc, k4 desc, best) as nth from (select *, row_number() over (partition by request, video_id order by k1 desc, k2 desc, k3 desc, k4 desc, best) as n from
  (select *, round(0.55 * anchor + 0.30 * compactness + 0.15 * chain_score, 9) as k1, round(anchor, 9) as k2, round(compactness, 9) as k3, round(chain_score, 9) as k4 from bf where coverage > 0)) where n = 1),
rq as (select *, row_number() over (partition by request order by k1 desc, k2 desc, k3 desc, k4 desc, k5 desc, k6 desc, k7 desc, best) as nth from (select *, row_number() over (partition by request, video_id order by k1 desc, k2 desc, k3 desc, k4 desc, k5 desc, k6 desc, k7 desc, best) as n from
  (select *, round(0.35 * shot_coherence + 0.25 * required_compactness + 0.20 * {GAP_SQL} + 0.10 * branch_score + 0.05 * anchor + 0.05 * compactness, 9) as k1, round(shot_coherence, 9) as k2, round(required_compactness, 9) as k3, round({GAP_SQL}, 9) as k4,
  round(branch_score, 9) as k5, round(anchor, 9) as k6, round(compactness, 9) as k7 from bf)) where n = 1),
phases as (select request, 1 as phase, pp as nth, video_id, place, start_sec, end_sec, frames, score from pool union all select request, 2, pp, video_id, place, start_sec, end_sec, frames, score from pool
  union all select request, 3, nth, video_id, place, start_sec, end_sec, frames, score from rc union all select request, 4, nth, video_id, place, start_sec, end_sec, frames, score from rq
  union all select request, 5, pp, video_id, place, start_sec, end_sec, frames, score from pool),
steps as (select *, row_number() over (partition by request order by phase, nth) as step from phases),
walk(request, step, phase, base, got) as (select distinct request, 0::bigint, 0, 0::bigint, []::struct(source varchar, video_id bigint, place bigint, s double, e double, frames varchar, score double)[] from steps
  union all select w.request, x.step, x.phase, case when x.phase <> w.phase then len(w.got) else w.base end,
  case when case x.phase
    when 1 then len(w.got) < 2 and len(list_filter(w.got, lambda g: g.video_id = x.video_id)) < 1
    when 2 then len(w.got) < 2 and len(list_filter(w.got, lambda g: g.video_id = x.video_id)) < 2 and len(list_filter(w.got, lambda g: g.video_id = x.video_id and (g.place = x.place or (least(g.e, x.end_sec) - greatest(g.s, x.start_sec)) >= 0.5 * (greatest(g.e, x.end_sec) - least(g.s, x.start_sec))))) = 0
    when 3 then len(w.got) < least(4, case when x.phase <> w.phase then len(w.got) else w.base end + 2) and len(list_filter(w.got, lambda g: g.video_id = x.video_id)) = 0
    when 4 then len(w.got) < least(5, case when x.phase <> w.phase then len(w.got) else w.base end + 1) and len(list_filter(w.got, lambda g: g.video_id = x.video_id)) = 0
    else len(w.got) < 5 and len(list_filter(w.got, lambda g: g.video_id = x.video_id)) < 2 and len(list_filter(w.got, lambda g: g.video_id = x.video_id and (g.place = x.place or (least(g.e, x.end_sec) - greatest(g.s, x.start_sec)) >= 0.5 * (greatest(g.e, x.end_sec) - least(g.s, x.start_sec))))) = 0 end
  then list_append(w.got, struct_pack(source := case x.phase when 3 then 'context_anchor_rescue' when 4 then 'required_chain_rescue' else 'pool' end, video_id := x.video_id, place := x.place, s := x.start_sec, e := x.end_sec, frames := x.frames, score := x.score)) else w.got end
  from walk w join steps x on x.request = w.request and x.step = w.step + 1),
final as (select request, arg_max(got, step) as got from walk group by request)"""


def _hits(spark, sf):
    return moments.event_hits(fx.event_results(spark, sf), BY)


def _chains(spark, sf):
    return moments.required_chains(_hits(spark, sf), BY, REQUIRED, CONTEXT, gap=GAP, span=SPAN)


def _scored(spark, sf):
    return moments.scored_moments(moments.with_context(_chains(spark, sf), CONTEXT, SPAN), fx.whole_results(spark, sf), BY, REQUIRED, CONTEXT, SPAN)


@query(f"with {PAIRS} select request, video_id, f0 || ',' || f1 as frames from pairs")
def J10_event_beam(spark, sf):
    """The ordered join that the beam prunes: every pair of required hits that follow each other in a video."""
    return moments.ordered_pairs(_hits(spark, sf), BY, REQUIRED, GAP, SPAN).select("request", "video_id", F.array_join("frames", ",").alias("frames"))


@query(f"with {BEAM} select request, video_id, place, f0 || ',' || f1 as frames from beam")
def B1_beam(spark, sf):
    return _chains(spark, sf).select("request", "video_id", F.col("place").cast("long").alias("place"), F.array_join(F.transform("chain", lambda h: h["frame_id"]), ",").alias("frames"))


@query(f"with {SCORED} select request, video_id, place, round(score, 6) as score, round(event_coverage, 6) as event_coverage from m")
def B2_moment_score(spark, sf):
    return _scored(spark, sf).select("request", "video_id", F.col("place").cast("long").alias("place"), r6("score").alias("score"), r6("event_coverage").alias("event_coverage"))


@query(f"with {CONTEXTED} select request, video_id, place, frames, start_sec, end_sec from full_chain")
def B3_context(spark, sf):
    m = _scored(spark, sf)
    return m.select("request", "video_id", F.col("place").cast("long").alias("place"), "frames", "start_sec", "end_sec")


@query(f"with {POOLED} select request, pp as pool_place, video_id, place from pool")
def B4_one_per_video(spark, sf):
    return moments.pooled(_scored(spark, sf), BY).select("request", F.col("pool_place").cast("long").alias("pool_place"), "video_id", F.col("place").cast("long").alias("place"))


# Without an unknown target there are no reserved slots: the first pass may take all five.
NMS = SELECTED.replace("when 1 then len(w.got) < 2 and", "when 1 then len(w.got) < 5 and").replace("when 2 then len(w.got) < 2 and", "when 2 then len(w.got) < 5 and").replace("when 3 then len(w.got) < least", "when 3 then false and len(w.got) < least").replace("when 4 then len(w.got) < least", "when 4 then false and len(w.got) < least")
OUT = "select request, i as candidate, g.source, g.video_id, g.frames, round(g.score, 6) as score from (select request, unnest(got) as g, generate_subscripts(got, 1) as i from final)"


@query(f"with recursive {NMS} {OUT}")
def B5_temporal_nms(spark, sf):
    """Greedy over the pool: one a video, then two, none that overlaps another of its video by half."""
    out = moments.selected(_scored(spark, sf), BY, REQUIRED, CONTEXT, target=False)
    return out.select("request", F.col("candidate").cast("long").alias("candidate"), "source", "video_id", "frames", r6("score").alias("score"))


@query(f"with recursive {SELECTED} {OUT}")
def B6_rescue_slots(spark, sf):
    """The same for a request with an unknown target: two slots for distinctive contexts and one for a chain strong in one branch."""
    out = moments.selected(_scored(spark, sf), BY, REQUIRED, CONTEXT)
    return out.select("request", F.col("candidate").cast("long").alias("candidate"), "source", "video_id", "frames", r6("score").alias("score"))
