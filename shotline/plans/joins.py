"""Temporal joins, windows, segments and event chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotline.operators import chains, fusion, ranking, temporal, vector
from shotline.plans.registry import query
from shotline.sources import fixtures as fx

r6 = lambda c: F.round(c, 6)
PTS = f"with {fx.POINTS_SQL}, fr as (select video_id, event_id as frame_id, ts, score from points where kind = 'view'), pr as (select event_id as probe_id, video_id, ts as t0 from points where kind = 'error'), "
ASOF = """near as (select * from (select probe_id, pr.video_id, frame_id, abs(ts - t0) as distance, row_number() over (partition by probe_id order by abs(ts - t0), ts, case when ts < t0 then -frame_id else frame_id end) as n
  from pr join fr using (video_id)) where n = 1)"""


def _frames(spark, sf):
    return fx.points(spark, sf).where("kind = 'view'").select("video_id", F.col("event_id").alias("frame_id"), "ts", "score")


def _probes(spark, sf):
    return fx.points(spark, sf).where("kind = 'error'").select(F.col("event_id").alias("probe_id"), "video_id", F.col("ts").alias("at"))


@query(f"with {fx.FRAMES_SQL} select d.doc_id, f.frame_id, f.video_id from documents d join frames f on f.frame_id = d.doc_id % 700")
def J1_equi_join(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 700).alias("frame_id"))
    return d.join(fx.frames(spark, sf), "frame_id").select("doc_id", "frame_id", "video_id")


@query(f"{PTS} {ASOF} select probe_id, video_id, frame_id, round(distance, 6) as distance from near")
def J2_nearest(spark, sf):
    return temporal.nearest(_probes(spark, sf), _frames(spark, sf)).select("probe_id", "video_id", "frame_id", r6("distance").alias("distance"))


@query(f"{PTS} x as (select 1) select probe_id, frame_id from pr join fr using (video_id) where ts between t0 - 86400 and t0 + 86400")
def J3_band(spark, sf):
    return temporal.band(_probes(spark, sf), _frames(spark, sf), 86400.0).select("probe_id", "frame_id")


@query(f"{PTS} x as (select 1) select probe_id, frame_id, round(exp(-abs(ts - t0) / 43200), 6) as weight from pr join fr using (video_id) where ts between t0 - 86400 and t0 + 86400")
def J4_band_weight(spark, sf):
    b = temporal.band(_probes(spark, sf), _frames(spark, sf), 86400.0)
    return b.select("probe_id", "frame_id", r6(temporal.decayed(F.col("ts") - F.col("at"), 43200.0)).alias("weight"))


INTERVALS = f"with {fx.SPEECH_SQL}, iv as (select *, greatest(start_sec, least(coalesce(lead(start_sec) over (partition by video_id order by start_sec, doc_id), start_sec + 45), start_sec + 45)) as end_sec from speech), vf as (select vec_id // 50 as video_id, vec_id as frame_id, cast((vec_id % 50) * 2 as double) as ts from embeddings)"
MAPPED = """, m as (select doc_id, video_id, frame_id, greatest(0, start_sec - ts, ts - end_sec) as off from iv join vf using (video_id) where ts between start_sec - 2 and end_sec + 2),
alone as (select * from (select iv.doc_id, iv.video_id, frame_id, row_number() over (partition by iv.doc_id order by abs(ts - start_sec), ts, frame_id) as n from iv join vf using (video_id) where doc_id not in (select doc_id from m)) where n = 1),
w as (select doc_id, video_id, frame_id, case when off <= 0 then 1 else exp(-off / 2) end as weight from m union all select doc_id, video_id, frame_id, 1 from alone)"""


def _video_frames(spark, sf):
    return fx.frames(spark, sf).select("video_id", "frame_id", F.col("timestamp_sec").alias("ts"))


@query(f"{INTERVALS} {MAPPED} select doc_id, video_id, frame_id, round(weight, 6) as weight from w")
def J5_interval_frames(spark, sf):
    iv = temporal.infer_intervals(fx.speech(spark, sf))
    return temporal.map_intervals(iv, _video_frames(spark, sf)).select("doc_id", "video_id", "frame_id", r6("weight").alias("weight"))


@query(f"{INTERVALS} select doc_id, video_id, start_sec, end_sec from iv")
def T6_intervals(spark, sf):
    return temporal.infer_intervals(fx.speech(spark, sf)).select("doc_id", "video_id", "start_sec", "end_sec")


@query(f"{INTERVALS} {MAPPED}, s as (select frame_id, video_id, doc_id, (doc_id % 13) / 12.0::double * weight as s from w), b as (select *, row_number() over (partition by frame_id order by round(s, 9) desc, doc_id) as n from s) select frame_id, video_id, doc_id, round(s, 6) as score, rank from (select *, row_number() over (order by round(s, 9) desc, frame_id) as rank from b where n = 1) where rank <= 40")
def T5_speech_search(spark, sf):
    from shotline.operators.text import speech_hits

    sp = fx.speech(spark, sf)
    mapped = temporal.map_intervals(temporal.infer_intervals(sp), _video_frames(spark, sf))
    hits = sp.select("doc_id", ((F.col("doc_id") % 13) / 12).alias("score"))
    return speech_hits(hits, mapped, 40).select("frame_id", "video_id", "doc_id", r6("score").alias("score"), "rank")


WIN = """select seed_id, frame_id, rank from (select probe_id as seed_id, frame_id, row_number() over (partition by probe_id order by score desc, frame_id) as rank from pr join fr using (video_id) where {}) where rank <= 30"""


@query(f"{PTS} x as (select 1) {WIN.format('ts > t0 and ts <= t0 + 86400')}")
def J6_forward_window(spark, sf):
    return temporal.window_search(_probes(spark, sf).withColumnRenamed("probe_id", "seed_id"), _frames(spark, sf), 86400.0).select("seed_id", "frame_id", "rank")


@query(f"{PTS} x as (select 1) {WIN.format('ts < t0 and ts >= t0 - 86400')}")
def J6_backward_window(spark, sf):
    return temporal.window_search(_probes(spark, sf).withColumnRenamed("probe_id", "seed_id"), _frames(spark, sf), 86400.0, forward=False).select("seed_id", "frame_id", "rank")


EV = f"with {fx.POINTS_SQL}, ev as (select event_id as frame_id, video_id, ts, score, kind from points), "
PAIR = """{n} as (select a.video_id, a.frame_id as f_i, b.frame_id as f_j, a.ts as ts_i, b.ts as ts_j, a.score as s_i, b.score as s_j, (a.score + b.score) / 2 as pair_score
  from ev a join ev b on a.video_id = b.video_id and b.ts > a.ts and b.ts <= a.ts + 172800 where a.kind = '{a}' and b.kind = '{b}')"""


def _event(spark, sf, kind=None):
    p = fx.points(spark, sf)
    p = p if kind is None else p.where(F.col("kind") == kind)
    return p.select(F.col("event_id").alias("frame_id"), "video_id", "ts", "score")


@query(f"{EV} {PAIR.format(n='p', a='view', b='click')} select f_i, f_j, round(pair_score, 6) as pair_score from p")
def J7_direct_pairs(spark, sf):
    return chains.direct_pairs(_event(spark, sf, "view"), _event(spark, sf, "click"), 172800.0).select("f_i", "f_j", r6("pair_score").alias("pair_score"))


@query(f"""{EV} {PAIR.format(n='d', a='view', b='click')},
fw as (select * from (select a.frame_id as f_i, b.frame_id as f_j, a.ts as ts_i, b.ts as ts_j, (a.score + b.score) / 2 as ps, row_number() over (partition by a.frame_id order by b.score desc, b.frame_id) as n from ev a join ev b on a.video_id = b.video_id and b.ts > a.ts and b.ts <= a.ts + 172800 where a.kind = 'view') where n <= 30),
bw as (select * from (select b.frame_id as f_i, a.frame_id as f_j, b.ts as ts_i, a.ts as ts_j, (a.score + b.score) / 2 as ps, row_number() over (partition by a.frame_id order by b.score desc, b.frame_id) as n from ev a join ev b on a.video_id = b.video_id and b.ts < a.ts and b.ts >= a.ts - 172800 where a.kind = 'click') where n <= 30),
u as (select f_i, f_j, ts_i, ts_j, pair_score as ps, 0 as br from d union all select f_i, f_j, ts_i, ts_j, ps, 1 from fw union all select f_i, f_j, ts_i, ts_j, ps, 2 from bw),
o as (select f_i, f_j, ps from (select *, row_number() over (partition by f_i, f_j order by ps desc, br) as n from u where ts_i < ts_j) where n = 1)
select f_i, f_j, round(ps, 6) as pair_score from o order by ps desc, f_i, f_j limit 200""")
def J8_bidirectional_pairs(spark, sf):
    every = _event(spark, sf)
    out = chains.bidirectional_pairs(_event(spark, sf, "view"), _event(spark, sf, "click"), every, every, 172800.0, 200)
    return out.select("f_i", "f_j", r6("pair_score").alias("pair_score"))


SHOT = "'v' || video_id || '_s' || (event_id // 100)"
SHOTS = f"shots as (select event_id, {SHOT} as shot_id from points)"
CHAINS = f"""{EV} {SHOTS}, {PAIR.format(n='p1', a='view', b='click')}, {PAIR.format(n='p2', a='click', b='purchase')},
j as (select p1.video_id, p1.f_i as e0, p1.f_j as e1, p1.s_i as s0, p1.s_j as s1, p2.f_j as e2, p2.s_j as s2, row_number() over (partition by p1.video_id, p1.f_i, p1.f_j order by p2.pair_score desc, p2.f_i, p2.f_j) as n
  from p1 join p2 on p1.video_id = p2.video_id and abs(p1.f_j // 100 - p2.f_i // 100) <= 3 and p2.ts_j > p1.ts_j and p2.ts_j <= p1.ts_j + 172800), c as (select * from j where n = 1)"""


def _chain_pairs(spark, sf):
    shot = F.concat(F.lit("v"), "video_id", F.lit("_s"), F.expr("frame_id div 100"))
    a, b, c = (_event(spark, sf, k).withColumn("shot_id", shot) for k in ("view", "click", "purchase"))
    return [chains.direct_pairs(a, b, 172800.0), chains.direct_pairs(b, c, 172800.0)]


@query(f"{CHAINS} select video_id, e0, e1, e2 from c")
def J9_chain_join(spark, sf):
    """The shot's number is the last integer of its id."""
    return chains.chain_join(_chain_pairs(spark, sf), 172800.0).select("video_id", "e0", "e1", "e2")


@query(f"{CHAINS} select video_id, e0, e1, e2, round((s0 / max(s0) over () + s1 / max(s1) over () + s2 / max(s2) over ()) / 3, 6) as score from c")
def F10_chain_scores(spark, sf):
    return chains.chain_join(_chain_pairs(spark, sf), 172800.0).select("video_id", "e0", "e1", "e2", r6("score").alias("score"))


# Candidates: videos with two frames of label 3 or more; these are anchors, the first bears the answer, a frame of label 7 is the global hit.
@query(f"""with recursive {fx.FRAMES_SQL}, f as (select frame_id, video_id, shot_id, timestamp_sec as ts, label from frames join (select vec_id as frame_id, label from embeddings) using (frame_id)),
an as (select * from (select video_id, frame_id, shot_id, ts, row_number() over (partition by video_id order by ts) as p from f where label = 3) where p <= 2), cd as (select video_id, min(ts) as s, max(ts) as e from an group by video_id having count(*) = 2),
ar as (select *, lag(frame_id) over w as bf, lag(shot_id) over w as bs, lag(ts) over w as bt, lead(frame_id) over w as af, lead(shot_id) over w as ash, lead(ts) over w as ats from f window w as (partition by video_id order by ts, frame_id)),
near as (select ar.*, s, e from ar join an using (frame_id) join cd on cd.video_id = ar.video_id where p = 1),
pr as (select video_id, 0 as o, p, 0 as side, ts, frame_id from an join cd using (video_id) union all select video_id, 1, 1, 0, bt, bf from near where bs = shot_id and bt between s - 20 and e + 20 union all select video_id, 1, 1, 1, ats, af from near where ash = shot_id and ats between s - 20 and e + 20
  union all select video_id, 2, 1, 0, min(ts), arg_min(frame_id, ts) from f join cd using (video_id) where label = 7 group by video_id),
pu as (select * from (select *, row_number() over (partition by video_id, frame_id order by o, p, side) as n from pr) where n = 1),
st as (select video_id, list(struct_pack(ts := ts, frame_id := frame_id) order by o, p, side)[1:12] as got from pu group by video_id),
wn as (select f.video_id, list(struct_pack(ts := ts, frame_id := frame_id) order by ts, frame_id) as win from f join cd using (video_id) where ts between s - 20 and e + 20 group by f.video_id),
walk as (select video_id, got, win from st join wn using (video_id) union all select video_id, list_append(got, struct_pack(ts := pick.ts, frame_id := pick.frame_id)), win from (select video_id, got, win,
  list_sort(list_transform(list_filter(win, lambda p: not list_contains(list_transform(got, lambda c: c.frame_id), p.frame_id)), lambda p: struct_pack(d := -list_min(list_transform(got, lambda c: abs(c.ts - p.ts))), ts := p.ts, frame_id := p.frame_id)))[1] as pick from walk where len(got) < 12) where pick is not null),
final as (select video_id, arg_max(got, len(got)) as got from walk group by video_id)
select video_id as candidate_id, unnest(list_transform(got, lambda g: g.frame_id)) as frame_id, generate_subscripts(got, 1) as place from final""")
def B7_farthest_points(spark, sf):
    """Anchors, their neighbours, the global hit, then the farthest frames of the window; tested against a loop too."""
    e = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_id"), "label")
    f = fx.frames(spark, sf).join(e, "frame_id").select("frame_id", "video_id", "shot_id", F.col("timestamp_sec").alias("ts"), "label")
    an = ranking.ranked(f.where("label = 3"), ["video_id"], ["ts"], "priority").where("priority <= 2")
    c = an.groupBy("video_id").agg(F.min("ts").alias("start_sec"), F.max("ts").alias("end_sec"), F.count("*").alias("n")).where("n = 2")
    c = c.select(F.col("video_id").alias("candidate_id"), "video_id", "start_sec", "end_sec")
    anchors = an.select(F.col("video_id").alias("candidate_id"), "priority", "frame_id", "shot_id", "ts", F.when(F.col("priority") == 1, "answer").otherwise("anchor").alias("kind"))
    hit = f.where("label = 7").groupBy("video_id").agg(F.min_by(F.struct("frame_id", "shot_id", "ts"), "ts").alias("h"))
    hit = hit.select(F.col("video_id").alias("candidate_id"), F.lit(1).alias("priority"), "h.frame_id", "h.shot_id", "h.ts", F.lit("global").alias("kind"))
    known = anchors.unionByName(hit).join(c.select("candidate_id"), "candidate_id", "left_semi")
    return chains.evidence_frames(c, known, f.drop("label"), 12, 20.0).withColumn("place", F.col("place").cast("long"))


@query(f"{PTS} x as (select 1) select probe_id, round(max(score), 6) as best, arg_max(frame_id, struct_pack(a := score, b := -frame_id)) as frame_id from pr join fr using (video_id) where ts between t0 - 86400 and t0 + 86400 group by all")
def B8_best_near(spark, sf):
    b = temporal.band(_probes(spark, sf), _frames(spark, sf), 86400.0)
    return b.groupBy("probe_id").agg(r6(F.max("score")).alias("best"), F.max_by("frame_id", F.struct("score", -F.col("frame_id"))).alias("frame_id"))


@query(f"""with {fx.SPARSE_SQL} select a.frame_id, b.frame_id as other_id from sparse a join sparse b on a.video_id = b.video_id and a.frame_id < b.frame_id
where abs(a.ts - b.ts) <= 3 or ((a.ts is null or b.ts is null) and a.shot_id = b.shot_id) or (a.ts is null and b.ts is null and a.shot_id is null and b.shot_id is null)""")
def J11_local_moment(spark, sf):
    """By time, by shot where one has no time, by video where neither has either."""
    f = fx.sparse_frames(spark, sf)
    return fusion.local_moments(f, f, []).where("frame_id < other_id").select("frame_id", "other_id")


@query(f"with {fx.FRAMES_SQL}, {fx.DOCS_SQL} select 'semi' as kind, count(*) as n from frames where frame_id in (select frame_id from text_docs where source = 'ocr') union all select 'anti', count(*) from frames where frame_id not in (select frame_id from text_docs where source = 'ocr')")
def J12_semi_anti(spark, sf):
    f, d = fx.frames(spark, sf), fx.text_docs(spark, sf).where("source = 'ocr'")
    semi = f.join(d, "frame_id", "left_semi").agg(F.lit("semi").alias("kind"), F.count("*").alias("n"))
    return semi.unionByName(f.join(d, "frame_id", "left_anti").agg(F.lit("anti").alias("kind"), F.count("*").alias("n")))


@query("with v as (select 'a' as model, vec_id as frame_id from embeddings where label <> 5 union all select 'b', vec_id from embeddings where label <> 3) select 'a' as model, frame_id from v where model = 'b' and frame_id not in (select frame_id from v where model = 'a') union all select 'b', frame_id from v where model = 'a' and frame_id not in (select frame_id from v where model = 'b')")
def J13_alignment(spark, sf):
    """One model lacks the frames of one label, the other those of another."""
    return fusion.aligned(_lacking(spark, sf))


def _lacking(spark, sf):
    e = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_id"), "label")
    a, b = e.where("label <> 5").select(F.lit("a").alias("model"), "frame_id"), e.where("label <> 3").select(F.lit("b").alias("model"), "frame_id")
    return a.unionByName(b)


@query(f"""{INTERVALS}, mo as (select vec_id as moment_id, vec_id // 50 as video_id, cast((vec_id % 50) * 2 as double) as m_start, cast((vec_id % 50) * 2 as double) + 4 as m_end from embeddings),
j as (select moment_id, doc_id, row_number() over (partition by moment_id order by abs((start_sec + end_sec) / 2 - (m_start + m_end) / 2), doc_id) as rank from mo join iv using (video_id) where start_sec <= m_end + 2 and end_sec >= m_start - 2) select * from j where rank <= 8""")
def J14_interval_overlap(spark, sf):
    """Every frame is a moment."""
    m = fx.frames(spark, sf).select(F.col("frame_id").alias("moment_id"), "video_id", F.col("timestamp_sec").alias("m_start"), (F.col("timestamp_sec") + 4).alias("m_end"))
    return temporal.overlap(m, temporal.infer_intervals(fx.speech(spark, sf))).select("moment_id", "doc_id", "rank")


@query(f"""{INTERVALS} {MAPPED}, {fx.FRAMES_SQL}, {fx.DOCS_SQL}, a as (select w.frame_id, string_agg(s.text, ' | ' order by s.doc_id) as asr from w join speech s using (doc_id) group by all), o as (select frame_id, string_agg(text, ' | ' order by doc_id) as ocr from text_docs where source = 'ocr' group by all)
select f.video_id, f.shot_id, f.frame_id, coalesce(md5(asr), '') as asr_md5, coalesce(md5(ocr), '') as ocr_md5, min(frame_index) over (partition by f.shot_id) as start_frame, max(frame_index) over (partition by f.shot_id) as end_frame from frames f left join a using (frame_id) left join o using (frame_id)""")
def J15_shot_listing(spark, sf):
    """Frames of shots with the speech mapped to them and the text on screen, joined in order (as digests)."""
    sp, d = fx.speech(spark, sf), fx.text_docs(spark, sf).where("source = 'ocr'").select("frame_id", "doc_id", "text")
    heard = temporal.map_intervals(temporal.infer_intervals(sp), _video_frames(spark, sf)).select("frame_id", "doc_id").join(sp.select("doc_id", "text"), "doc_id")
    out = temporal.shot_listing(fx.frames(spark, sf), heard, d)
    digest = lambda c: F.when(F.col(c) == "", "").otherwise(F.md5(c)).alias(f"{c}_md5")
    return out.select("video_id", "shot_id", "frame_id", digest("asr"), digest("ocr"), "start_frame", "end_frame")


SIM = f"""with {fx.FRAMES_SQL}, q as (select embedding::double[] as q from embeddings where vec_id = 0),
fs as (select frame_id, video_id, shot_id, timestamp_sec as ts, row_number() over (partition by video_id order by frame_index, frame_id) - 1 as pos, round(list_inner_product(embedding::double[], q) / (sqrt(list_inner_product(embedding::double[], embedding::double[])) * sqrt(list_inner_product(q, q))), 6) as sim from frames, q),
seeds as (select frame_id as seed_id, video_id, shot_id, pos as seed_pos from fs)"""
SCAN = """, w{d} as (select seed_id, s.video_id, s.shot_id, seed_pos, {s} * (pos - seed_pos) as step, sim from seeds s join fs on s.video_id = fs.video_id and s.shot_id = fs.shot_id where {s} * (pos - seed_pos) >= 0),
r{d} as (select *, coalesce(sim >= max(sim) over (partition by seed_id order by step rows between unbounded preceding and 1 preceding), true) as rec from w{d}),
l{d} as (select *, max(case when rec then step end) over (partition by seed_id order by step) as last from r{d}),
e{d} as (select seed_id, video_id, shot_id, seed_pos, seed_pos + {s} * case when min(case when step - last >= 3 then step end) is null then max(step) else greatest(0, min(case when step - last >= 3 then step end) - 3) end as edge from l{d} group by seed_id, video_id, shot_id, seed_pos)"""


def _similar(spark, sf):
    q = fx.table(spark, sf, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))
    e = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_id"), "embedding").crossJoin(F.broadcast(q))
    sim = e.select("frame_id", r6(vector.dot("embedding", "q") / (vector.norm("embedding") * vector.norm("q"))).alias("sim"))
    return vector.positions(fx.frames(spark, sf)).join(sim, "frame_id").withColumnRenamed("timestamp_sec", "ts")


def _seeds(f):
    return f.select(F.col("frame_id").alias("seed_id"), "video_id", "shot_id", "pos")


@query(f"{SIM} {SCAN.format(d='f', s='1')} select seed_id, edge as end_pos from ef")
def W3_forward_scan(spark, sf):
    """Every frame is a seed."""
    f = _similar(spark, sf)
    return temporal.forward_ends(f, _seeds(f)).select("seed_id", F.col("end_pos").cast("long"))


@query(f"{SIM} {SCAN.format(d='b', s='-1')} select seed_id, edge as start_pos from eb")
def W4_backward_scan(spark, sf):
    """Every frame is a seed."""
    f = _similar(spark, sf)
    return temporal.backward_starts(f, _seeds(f)).select("seed_id", F.col("start_pos").cast("long"))


SEG = f"""{SIM}, s as (select video_id, shot_id, pos as start_pos, pos + 1 as end_pos, pos as centre from fs where sim > 0.1),
n as (select *, case when coalesce(start_pos > max(end_pos) over (partition by video_id, shot_id order by start_pos rows between unbounded preceding and 1 preceding) + 2, true) then 1 else 0 end as new from s),
i as (select *, sum(new) over (partition by video_id, shot_id order by start_pos) as island from n), seg as (select video_id, shot_id, min(start_pos) as start_pos, max(end_pos) as end_pos, min(centre) as centre from i group by video_id, shot_id, island)"""


def _segments(spark, sf):
    s = _similar(spark, sf).where("sim > 0.1").select("video_id", "shot_id", F.col("pos").alias("start_pos"), (F.col("pos") + 1).alias("end_pos"), F.col("pos").alias("centre"))
    return temporal.merge_segments(s)


@query(f"{SEG} select * from seg")
def W5_merge_segments(spark, sf):
    return _segments(spark, sf).select("video_id", "shot_id", *[F.col(c).cast("long").alias(c) for c in ("start_pos", "end_pos", "centre")])


@query(f"{SEG} select seg.video_id, seg.shot_id, start_pos, string_agg(frame_id::varchar, ',' order by pos) as frame_ids, min(ts) as first_ts, max(ts) as last_ts from seg join fs on seg.video_id = fs.video_id and seg.shot_id = fs.shot_id and pos between start_pos and end_pos group by all")
def W6_gather(spark, sf):
    g = temporal.gather(_segments(spark, sf), _similar(spark, sf).select("video_id", "shot_id", "pos", "frame_id", "ts"))
    return g.select("video_id", "shot_id", F.col("start_pos").cast("long"), "frame_ids", "first_ts", "last_ts")


@query(f"with {fx.FRAMES_SQL}, r as (select *, row_number() over (partition by shot_id order by timestamp_sec, frame_id) - 1 as i, count(*) over (partition by shot_id) as n from frames) select shot_id, frame_id from r where i = n // 2")
def W7_middle_frame(spark, sf):
    return temporal.middle_frame(fx.frames(spark, sf)).select("shot_id", "frame_id")


@query(f"with {fx.FRAMES_SQL}, r as (select *, row_number() over (partition by shot_id order by timestamp_sec, frame_id) - 1 as i, count(*) over (partition by shot_id) as n from frames) select f.frame_id, m.frame_id as representative_id from frames f join (select * from r where i = n // 2) m using (shot_id)")
def W8_representative(spark, sf):
    f = fx.frames(spark, sf)
    m = temporal.middle_frame(f).select("shot_id", F.col("frame_id").alias("representative_id"))
    return f.join(m, "shot_id").select("frame_id", "representative_id")


CUT_SCORES = "scores as (select user_id as video_id, event_id % 300 as frame, least(1.0, value / 200) as score from events)"


def _cut_scores(spark, sf):
    return fx.table(spark, sf, "events").select(F.col("user_id").alias("video_id"), (F.col("event_id") % 300).alias("frame"), F.least(F.lit(1.0), F.col("value") / 200).alias("score"))


@query(f"with {CUT_SCORES}, c as (select video_id, frame from scores where score >= 0.5), b as (select distinct * from c where frame between 0 and 298 union select distinct video_id, 299 from c) select video_id, coalesce(lag(frame) over (partition by video_id order by frame) + 1, 0) as start_frame, frame as end_frame, round(frame / 25.0::double, 6) as end_sec from b")
def W9_shots(spark, sf):
    """Frames whose cut score reaches the threshold (W10) are boundaries."""
    return temporal.shots_from_cuts(temporal.cut_frames(_cut_scores(spark, sf)), 300, 25.0).select("video_id", "start_frame", "end_frame", r6("end_sec").alias("end_sec"))


@query(f"with {CUT_SCORES} select video_id, frame from scores where score >= 0.5")
def W10_cut_threshold(spark, sf):
    return temporal.cut_frames(_cut_scores(spark, sf))


@query("""with v as (select user_id as video_id, count(*) as n from events group by all), p as (select video_id, n, list_concat(list_concat(list_transform(range(25), lambda i: 0), range(n)), list_transform(range(25 + 50 - case when n % 50 = 0 then 50 else n % 50 end), lambda i: n - 1)) as padded from v),
w as (select video_id, n, padded, unnest(range(0, (len(padded) - 100) // 50 + 1)) as w from p) select video_id, w as window, padded[w * 50 + 1] as first_frame, padded[w * 50 + 100] as last_frame, padded[w * 50 + 26] as keep_from, padded[w * 50 + 75] as keep_to from w""")
def W11_model_windows(spark, sf):
    """A video has as many frames as its user has events."""
    v = fx.table(spark, sf, "events").groupBy(F.col("user_id").alias("video_id")).agg(F.count("*").alias("n_frames"))
    return temporal.model_windows(v).select("video_id", "window", *[F.col(c).cast("long").alias(c) for c in ("first_frame", "last_frame", "keep_from", "keep_to")])


@query("with s as (select o_orderkey as shot_id, o_orderkey % 100 as a, o_orderkey % 100 + o_custkey % 50 as b from orders), p as (select unnest([0.0, 0.25, 0.5, 0.75, 1.0]::double[]) as p), x as (select shot_id, a + round_even((b - a) * p, 0)::bigint as frame_index from s, p) select distinct shot_id, frame_index from x")
def W12_sampling(spark, sf):
    s = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("shot_id"), (F.col("o_orderkey") % 100).alias("start_frame"), (F.col("o_orderkey") % 100 + F.col("o_custkey") % 50).alias("end_frame"))
    return temporal.sample_indices(s, [0.0, 0.25, 0.5, 0.75, 1.0]).select("shot_id", "frame_index")


@query(f"""with recursive {fx.SPEECH_SQL}, s as (select video_id, row_number() over (partition by video_id order by start_sec, doc_id) as i, len(regexp_extract_all(text, '[^ \\t-\\r]+')) as w from speech),
walk as (select video_id, i, 0 as chunk, w as used, w from s where i = 1 union all select s.video_id, s.i, case when walk.used + s.w <= 60 then chunk else chunk + 1 end, case when walk.used + s.w <= 60 then walk.used + s.w else s.w end, s.w from walk join s on s.video_id = walk.video_id and s.i = walk.i + 1)
select video_id, chunk::bigint as chunk, sum(w)::bigint as n_words, count(*) as n_segments from walk group by all""")
def W13_word_chunks(spark, sf):
    """A resetting sum: a fold over the segments of a video; tested against a loop."""
    return temporal.word_chunks(fx.speech(spark, sf), 60)


@query("with s as (select event_id as id, event_id % 100 / 10.0::double as a, event_id % 100 / 10.0::double + abs(value) as b from events), n as (select *, greatest(1, floor((b - a) / 30) + case when (b - a) - floor((b - a) / 30) * 30 >= 0.1 then 1 else 0 end)::bigint as n from s) select id, k as window, round(a + k * 30, 6) as from_sec, round(case when k = n - 1 then b else a + k * 30 + 30 end, 6) as to_sec from n, range(0, n) t(k)")
def W14_speech_windows(spark, sf):
    a = (F.col("event_id") % 100) / 10
    s = fx.table(spark, sf, "events").select(F.col("event_id").alias("id"), a.alias("start_sec"), (a + F.abs("value")).alias("end_sec"))
    return temporal.speech_windows(s).select("id", "window", r6("from_sec").alias("from_sec"), r6("to_sec").alias("to_sec"))


@query(f"with {fx.FRAMES_SQL} select frame_id, lag(frame_id) over w as before_id, lead(frame_id) over w as after_id from frames window w as (partition by shot_id order by timestamp_sec, frame_id)")
def W15_neighbours(spark, sf):
    return temporal.neighbours(fx.frames(spark, sf))


@query(f"with {fx.POINTS_SQL}, c as (select *, coalesce(ts > lag(ts) over (partition by video_id order by event_id), true) as ok from points) select video_id as answer_id, bool_and(ok) as chronological from c group by all")
def W17_chronology(spark, sf):
    p = fx.points(spark, sf).select(F.col("video_id").alias("answer_id"), F.col("event_id").alias("event_index"), "ts")
    return chains.chronological(p)


@query(f"{SIM}, g as (select *, ts - lag(ts) over (partition by shot_id order by ts, frame_id) as gap from fs), a as (select shot_id, avg(sim) as m, coalesce(max(gap), 0) as gap, count(*) as n from g group by all) select shot_id, round(0.7 * m + 0.3 * case when gap <= 0 then 1 else 1 / (1 + gap) end, 5) as composite, n from a")
def A5_shot_validation(spark, sf):
    v = temporal.shot_validation(_similar(spark, sf).select("shot_id", "frame_id", "ts", "sim"))
    return v.select("shot_id", F.round("composite", 5).alias("composite"), "n")
