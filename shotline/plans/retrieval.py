"""Vector search, fusion, ranking and full-text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotline.functions import language as lang
from shotline.functions import scalar as x
from shotline.operators import fusion, ranking, text, tiles, vector
from shotline.plans.registry import query
from shotline.sources import fixtures as fx

r6 = lambda c: F.round(c, 6)
HEAD = f"with {fx.FRAMES_SQL}, {fx.VECTORS_SQL}, {fx.QUERIES_SQL}, "
SCORED = """scored as (select query_id, v.model, frame_id, list_inner_product(e, q) / ((sqrt(list_inner_product(e, e)) + 1e-12) * (sqrt(list_inner_product(q, q)) + 1e-12)) as score
  from vectors v join queries using (model)),
ranked as (select *, row_number() over (partition by query_id, model order by score desc, frame_id) as rank from scored), hits as (select * from ranked where rank <= 100)"""
SRRF = """srrf as (select query_id, frame_id, sum(0.5 / (60 + rank) + 0.5 * (score - lo) / greatest(hi - lo, 1e-9)) as fused from
  (select *, min(score) over (partition by query_id, model) as lo, max(score) over (partition by query_id, model) as hi from hits) group by all)"""


def _scored(spark, sf):
    return vector.scored_in_blocks(fx.vectors(spark, sf), fx.queries(spark, sf))


def _hits(spark, sf, k=100):
    return vector.top_k(fx.vectors(spark, sf), fx.queries(spark, sf), k)


def _fused(spark, sf):
    return fusion.srrf(_hits(spark, sf).drop("rank"), ["query_id"])


def _ranked(spark, sf, k=100):
    """Fused hits with rank and frame columns."""
    top = ranking.top_per(_fused(spark, sf), ["query_id"], [F.desc(F.round("score", 9)), "frame_id"], k)
    return top.join(fx.frames(spark, sf), "frame_id")


RANKED = """, fr as (select *, row_number() over (partition by query_id order by round(fused, 9) desc, frame_id) as rank from srrf),
r as (select fr.query_id, fr.rank, fr.fused as score, f.* from fr join frames f using (frame_id) where fr.rank <= 100)"""


@query(f"{HEAD} {SCORED}, {SRRF} {RANKED} select query_id, rank, frame_id, video_id, shot_id, round(score, 6) as score from r where rank <= 20")
def entry_search(spark, sf):
    """The basic search: top-k by each model, SRRF, late hydration."""
    return _ranked(spark, sf, 20).select("query_id", "rank", "frame_id", "video_id", "shot_id", r6("score").alias("score"))


@query(f"{HEAD} {SCORED} select query_id, model, frame_id, rank, round(score, 6) as score from hits where rank <= 10")
def V1_cosine_topk(spark, sf):
    return _hits(spark, sf, 10).select("query_id", "model", "frame_id", "rank", r6("score").alias("score"))


@query(f"with {fx.VECTORS_SQL} select model, frame_id, round(list_inner_product(e, e) / power(sqrt(list_inner_product(e, e)) + 1e-12, 2), 6) as unit, round(e[1] / (sqrt(list_inner_product(e, e)) + 1e-12), 6) as first from vectors")
def V2_normalise(spark, sf):
    v = fx.vectors(spark, sf).withColumn("z", vector.normalised("embedding"))
    return v.select("model", "frame_id", r6(vector.dot("z", "z")).alias("unit"), r6(F.col("z")[0]).alias("first"))


@query(f"{HEAD} {SCORED}, m as (select model, frame_id, max(score) as score from hits group by all) select model, frame_id, round(score, 6) as score, rank from (select *, row_number() over (partition by model order by score desc, frame_id) as rank from m) where rank <= 50")
def V3_variant_max_merge(spark, sf):
    return vector.max_merge(_hits(spark, sf).drop("rank"), 50).select("model", "frame_id", "rank", r6("score").alias("score"))


@query(f"{HEAD} {SCORED} select model || ':' || query_id as branch, frame_id, rank, round(score, 6) as score from hits where rank <= 30")
def V4_branch_search(spark, sf):
    return _hits(spark, sf, 30).select(F.concat_ws(":", "model", "query_id").alias("branch"), "frame_id", "rank", r6("score").alias("score"))


@query(f"{HEAD} {SCORED} select query_id, model, round(score, 4) as sub_score from scored where frame_id = 11")
def V5_sub_score(spark, sf):
    v = vector.lookup(fx.vectors(spark, sf), 11, "a").unionByName(vector.lookup(fx.vectors(spark, sf), 11, "b"))
    one = F.broadcast(v.withColumnRenamed("embedding", "e"))  # a frame's two vectors
    return fx.queries(spark, sf).join(one, "model").select("query_id", "model", F.round(vector.cosine("e", "q"), 4).alias("sub_score"))


@query(f"{HEAD} {SCORED} select query_id, model, count(*) as n from ranked where rank <= 100 group by all")
def V6_pool(spark, sf):
    return _hits(spark, sf, vector.pool_size(20, 2)).groupBy("query_id", "model").agg(F.count("*").alias("n"))


@query("select vec_id as frame_id, len(embedding) as dims, round(embedding[1]::double, 6) as first from embeddings where vec_id = 5")
def S10_point_lookup(spark, sf):
    v = vector.lookup(fx.vectors(spark, sf), 5, "a")
    return v.select("frame_id", F.size("embedding").cast("long").alias("dims"), r6(F.col("embedding")[0].cast("double")).alias("first"))


@query(f"with {fx.VECTORS_SQL} select model, count(*) as n from vectors where model in ('a') group by all")
def P4_model_subset(spark, sf):
    return vector.model_subset(fx.vectors(spark, sf), ["a"]).groupBy("model").agg(F.count("*").alias("n"))


@query(f"with {fx.FRAMES_SQL} select frame_id, video_id, row_number() over (partition by video_id order by frame_index, frame_id) - 1 as pos from frames")
def S6_positions(spark, sf):
    return vector.positions(fx.frames(spark, sf)).select("frame_id", "video_id", F.col("pos").cast("long").alias("pos"))


@query(f"{HEAD} {SCORED} select query_id, model, frame_id, rank from ranked")
def W1_ranks(spark, sf):
    """Every frame's rank in its branch, ties by id."""
    return tiles.ranks(fx.vectors(spark, sf), fx.queries(spark, sf))


@query(f"{HEAD} {SCORED} select query_id, model, frame_id, round(case when max(score) over w - min(score) over w <= 1e-9 then 0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end, 6) as spread, round(case when max(score) over w > 0 then score / max(score) over w else score end, 6) as share from hits window w as (partition by query_id, model)")
def W2_normalise(spark, sf):
    """Scores of a branch over 0..1, and as shares of its best."""
    by = ["query_id", "model"]
    return _hits(spark, sf).select(*by, "frame_id", r6(ranking.min_max("score", by)).alias("spread"), r6(ranking.max_normalised("score", by)).alias("share"))


@query(f"{HEAD} {SCORED}, {SRRF} select query_id, frame_id, round(fused, 6) as score from srrf")
def F1_srrf(spark, sf):
    return _fused(spark, sf).select("query_id", "frame_id", r6("score").alias("score"))


@query(f"""{HEAD} {SCORED}, n as (select *, score / case when max(score) over (partition by query_id, model) <= 1e-12 then 1 else max(score) over (partition by query_id, model) end as x from scored),
w as (select query_id, frame_id, sum(x * case model when 'a' then 0.75 else 0.25 end) as score from n group by all)
select query_id, frame_id, rank, round(score, 6) as score from (select *, row_number() over (partition by query_id order by round(score, 9) desc, frame_id) as rank from w) where rank <= 25""")
def F2_wsf(spark, sf):
    out = fusion.wsf_search(fx.vectors(spark, sf), fx.queries(spark, sf), ["a", "b"], {"a": 3.0}, 25)
    return out.select("query_id", "frame_id", "rank", r6("score").alias("score"))


@query(f"{HEAD} {SCORED} select query_id, frame_id, round(avg(x), 6) as score from (select *, score / case when max(score) over (partition by query_id, model) <= 1e-12 then 1 else max(score) over (partition by query_id, model) end as x from scored) group by all")
def F3_weighted_sum(spark, sf):
    return tiles.mean(fx.vectors(spark, sf), fx.queries(spark, sf)).select("query_id", "frame_id", r6("score").alias("score"))


@query(f"""{HEAD} {SCORED}, nq as (select count(distinct query_id) as n from queries), g as (select * from ranked where model = 'a' and rank <= 40), pool as (select frame_id from (select frame_id, sum(x) / any_value(n) as s from nq,
  (select *, score / case when max(score) over (partition by query_id) <= 1e-12 then 1 else max(score) over (partition by query_id) end as x from g) group by all) order by round(s, 9) desc, frame_id limit 30),
sp as (select s.* from scored s join pool using (frame_id) where model = 'b'),
f as (select frame_id, sum(x) / any_value(n) as s from nq, (select *, score / case when max(score) over (partition by query_id) <= 1e-12 then 1 else max(score) over (partition by query_id) end as x from sp) group by all)
select frame_id, round(s, 6) as score from f order by round(s, 9) desc, frame_id limit 10""")
def F4_two_stage(spark, sf):
    """Every query is a sub-query: general ones by model a, specific ones by model b."""
    one = F.lit(1).alias("one")
    general = _hits(spark, sf, 40).where("model = 'a'").select(one, F.col("query_id").alias("branch"), "frame_id", "score")
    specific = _scored(spark, sf).where("model = 'b'").select(one, F.col("query_id").alias("branch"), "frame_id", "score")
    return fusion.two_stage(general, specific, ["one"], 30, 10).select("frame_id", r6("score").alias("score"))


@query("select event_id, round(least(0.5, greatest(0.0, (event_id % 11) / 10.0::double * ((event_id % 7) / 6.0::double))), 6) as weight from events")
def F5_adaptive_weight(spark, sf):
    e = fx.table(spark, sf, "events")
    return e.select("event_id", fusion.adaptive_weight((F.col("event_id") % 11) / 10, (F.col("event_id") % 7) / 6).alias("weight"))


@query(f"{HEAD} {SCORED} select query_id, model, frame_id, rank, round(score, 6) as score, round(case when hi - lo <= 1e-9 then 1 else (score - lo) / (hi - lo) end, 6) as normalized from (select *, min(score) over (partition by query_id, model) as lo, max(score) over (partition by query_id, model) as hi from hits)")
def F6_diagnostics(spark, sf):
    return fusion.diagnostics(_hits(spark, sf).drop("rank"), ["query_id", "model"]).select("query_id", "model", "frame_id", "rank", r6("score").alias("score"), r6("normalized").alias("normalized"))


@query(f"{HEAD} {SCORED}, {SRRF} {RANKED} select query_id, frame_id, round(score / max(score) over (partition by query_id), 6) as score from r")
def F7_max_normalise(spark, sf):
    r = _ranked(spark, sf).withColumn("n", ranking.max_normalised("score", ["query_id"]))
    return r.select("query_id", "frame_id", r6("n").alias("score"))


@query("select event_id, round((x + 0.3 * o / greatest(20.0, 15.0) + 0.3 * a / greatest(10.0, 15.0)) / 1.6::double, 6) as score from (select event_id, (event_id % 100) / 100.0::double as x, (event_id % 20)::double as o, coalesce(case when event_id % 3 = 0 then null else (event_id % 10)::double end, 0) as a from events)")
def F9_window_bonus(spark, sf):
    e = fx.table(spark, sf, "events")
    i = F.col("event_id")
    asr = F.when(i % 3 != 0, (i % 10).cast("double"))
    return e.select("event_id", r6(fusion.window_bonus((i % 100) / 100, (i % 20).cast("double"), asr, F.lit(20.0), F.lit(10.0))).alias("score"))


@query(f"{HEAD} {SCORED}, {SRRF} {RANKED} select query_id, frame_id, round(0.6 * ((frame_id * 7 % 100) / 100.0::double) + 0.4 * (score - min(score) over w) / case when max(score) over w - min(score) over w <= 0 then 1 else max(score) over w - min(score) over w end, 6) as score from r window w as (partition by query_id)")
def F11_cross_encoder_blend(spark, sf):
    r = _ranked(spark, sf).withColumn("model_score", (F.col("frame_id") * 7 % 100) / 100)
    return fusion.cross_encoder_blend(r, ["query_id"]).select("query_id", "frame_id", r6("blended").alias("score"))


@query(f"{HEAD} {SCORED}, {SRRF} {RANKED} select query_id, frame_id, case when rank <= 50 then row_number() over (partition by query_id order by rank > 50, (frame_id * 7 % 100) desc, rank) else rank end as place from r")
def F12_rerank_head(spark, sf):
    """The first fifty rescored, the tail behind them as ranked."""
    r = _ranked(spark, sf)
    head = ranking.ranked(r.where("rank <= 50").withColumnRenamed("rank", "was"), ["query_id"], [F.desc(F.col("frame_id") * 7 % 100), "was"], "place")
    return head.select("query_id", "frame_id", "place").unionByName(r.where("rank > 50").select("query_id", "frame_id", F.col("rank").alias("place")))


@query(f"select event_id, case when event_type in ('view', 'error') and c <= 0 then least(1, greatest(0.5, 2 * b)) else c end::double as confidence from (select *, least(1.0, greatest(0.0, (value - 10) / 100)) as c, {fx.K_SQL} / 100 as b from events)")
def F13_modality_confidence(spark, sf):
    """Keywords come with two kinds of events; the bonus is the JSON's k / 100."""
    e = fx.table(spark, sf, "events")
    words = F.when(F.col("event_type").isin("view", "error"), F.array("event_type")).otherwise(F.array().cast("array<string>"))
    return e.select("event_id", fusion.modality_confidence((F.col("value") - 10) / 100, words, fx.k_of("props") / 100).alias("confidence"))


UNION = f"""{fx.SPARSE_SQL}, hs as (select *, count(*) over (partition by query_id, model) as size from hits), h as (select query_id, model, f.*, case when size <= 1 then 1.0::double else greatest(0, 1 - (rank - 1) / size) end as rs from hs join sparse f using (frame_id)),
bs as (select query_id, frame_id, video_id, shot_id, ts, max(rs) as best from h group by all),
near as (select b.query_id, b.frame_id, h.model, max(h.rs) as m from bs b join h on b.query_id = h.query_id and b.video_id = h.video_id
  and (abs(b.ts - h.ts) <= 3 or ((b.ts is null or h.ts is null) and (b.shot_id = h.shot_id or (b.ts is null and h.ts is null and b.shot_id is null and h.shot_id is null)))) group by all),
un as (select b.*, least(1, s / 3) as consensus, 0.8 * best + 0.2 * least(1, s / 3) as score from bs b join (select query_id, frame_id, sum(m) as s from near group by all) using (query_id, frame_id)),
uk as (select *, row_number() over (partition by query_id order by round(score, 9) desc, frame_id) as rank from un)"""


def _union(spark, sf):
    """Branches' hits as one list with consensus; a third branch was asked for and found nothing."""
    h = _hits(spark, sf).join(fx.sparse_frames(spark, sf), "frame_id")
    u = fusion.consensus(h, ["query_id"], 3)
    return ranking.ranked(u, ["query_id"], [F.desc(F.round("score", 9)), "frame_id"]).withColumnRenamed("ts", "timestamp_sec")


@query(f"{HEAD} {SCORED}, {UNION} select query_id, frame_id, rank, round(consensus, 6) as consensus, round(score, 6) as score from uk")
def F14_consensus(spark, sf):
    return _union(spark, sf).select("query_id", "frame_id", "rank", r6("consensus").alias("consensus"), r6("score").alias("score"))


@query(f"""{HEAD} {SCORED}, {SRRF} {RANKED}, v as (select query_id, frame_id, case when n <= 1 then 1.0::double else greatest(0, 1 - (rank - 1) / n) end as s, 1 as vis from (select *, count(*) over (partition by query_id) as n from r)),
a as (select query_id, frame_id, 0.2 * case when n <= 1 then 1.0::double else greatest(0, 1 - (rank - 1) / n) end as s, 0 as vis from (select *, count(*) over (partition by query_id, model) as n from hits where rank <= 60))
select query_id, frame_id, round(sum(s), 6) as score, max(vis) = 1 as is_visual from (select * from v union all select * from a) group by all""")
def F15_auxiliary_merge(spark, sf):
    """The fused list, with the first sixty of each model as further lists."""
    aux = _hits(spark, sf, 60).withColumnRenamed("model", "source")
    return fusion.auxiliary_merge(_ranked(spark, sf), aux, ["query_id"]).select("query_id", "frame_id", r6("score").alias("score"), "is_visual")


@query("select event_id, round(0.35 * rs + 0.65 * c, 6) as score from (select event_id, (event_id % 100) / 100.0::double as rs, (event_id % 37) / 36.0::double as c from events) where c >= 0.65")
def F16_final_score(spark, sf):
    e = fx.table(spark, sf, "events").select("event_id", ((F.col("event_id") % 100) / 100).alias("rs"), ((F.col("event_id") % 37) / 36).alias("c"))
    return e.where("c >= 0.65").select("event_id", r6(0.35 * F.col("rs") + 0.65 * F.col("c")).alias("score"))


@query(f"{HEAD} {SCORED} select query_id, frame_id, place from (select query_id, frame_id, row_number() over (partition by query_id order by round(score, 9) desc, frame_id, model) as place from hits) where place <= 15")
def L1_topk(spark, sf):
    top = ranking.ranked(_hits(spark, sf), ["query_id"], [F.desc(F.round("score", 9)), "frame_id", "model"], "place")
    return top.where("place <= 15").select("query_id", "frame_id", "place")


@query(f"{HEAD} {SCORED}, {SRRF} {RANKED}, d as (select *, row_number() over (partition by query_id, shot_id order by rank) > 2 as later from r) select * from (select query_id, frame_id, row_number() over (partition by query_id order by later, rank) as place from d) where place <= 20")
def L2_shot_diversity(spark, sf):
    return ranking.diversify(_ranked(spark, sf), ["query_id"], "shot_id", 2, 20).select("query_id", "frame_id", "place")


RESERVES = """ra as (select query_id, video_id, 'a' as model, arg_min(frame_id, rank) as frame_id from hits join sparse using (frame_id) where model = 'a' group by query_id, video_id),
rb as (select h.query_id, s.video_id, 'b' as model, arg_min(h.frame_id, h.rank) as frame_id from hits h join sparse s on s.frame_id = h.frame_id left join ra on ra.query_id = h.query_id and ra.video_id = s.video_id
  where h.model = 'b' and (ra.frame_id is null or ra.frame_id <> h.frame_id) group by h.query_id, s.video_id), reserves as (select * from ra union all select * from rb)"""
MOMENT = "case when ts is not null then 't' || coalesce(shot_id::varchar, '?') || ':' || floor(ts / 2)::bigint when shot_id is not null then 's' || shot_id else 'f' || frame_id end"


@query(f"""{HEAD} {SCORED}, {UNION}, {RESERVES}, d as (select u.*, {MOMENT} as moment, v.frame_id is not null as res from uk u left join (select distinct query_id, frame_id from reserves) v using (query_id, frame_id)),
k as (select *, res and row_number() over (partition by query_id, video_id order by res desc, rank) <= 3 as kept from d), c as (select *, bool_or(kept) over (partition by query_id, video_id, moment) as shown from k),
f as (select *, case when kept then 0 when not shown and rank = min(rank) over (partition by query_id, video_id, moment) then 1 else 2 end as class from c)
select * from (select query_id, video_id, frame_id, row_number() over (partition by query_id, video_id order by class, rank) as place from f) where place <= 3""")
def L3_video_cap(spark, sf):
    """Three of a video: reserved frames, first frames of other moments, the rest."""
    out = ranking.cap_per_video(_union(spark, sf), ["query_id"], 3, _reserves(spark, sf))
    return out.select("query_id", "video_id", "frame_id", "place")


def _reserves(spark, sf):
    return ranking.branch_reserves(_hits(spark, sf).join(fx.sparse_frames(spark, sf), "frame_id"), ["query_id"], ["a", "b"])


@query(f"{HEAD} {SCORED}, {fx.SPARSE_SQL}, {RESERVES} select query_id, model, video_id, frame_id from reserves")
def L4_branch_reserves(spark, sf):
    return _reserves(spark, sf).select("query_id", "model", "video_id", "frame_id")


@query(f"{HEAD} {SCORED}, {SRRF} {RANKED}, d as (select *, row_number() over (partition by query_id, video_id, shot_id, floor(timestamp_sec / 2) order by rank) as n from r) select * from (select query_id, video_id, frame_id, row_number() over (partition by query_id, video_id order by rank) as place from d where n = 1) where place <= 4")
def L5_witnesses(spark, sf):
    return ranking.witnesses(_ranked(spark, sf), ["query_id"]).select("query_id", "video_id", "frame_id", "place")


@query(f"{HEAD} {SCORED}, {SRRF} {RANKED} select query_id, video_id, min(rank) as first_rank, count(*) as n_hits from r group by all")
def A11_video_trace(spark, sf):
    return ranking.first_per_video(_ranked(spark, sf), ["query_id"])


PLAIN = "replace(replace(replace(replace(strip_accents(lower(replace(replace(text, 'đ', 'd'), 'Đ', 'D'))), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'ø', 'o')"
TOK = f"tok as (select doc_id, source, frame_id, text, list_filter(regexp_extract_all({PLAIN}, '[\\p{{L}}\\p{{N}}_]+'), lambda t: not list_contains({list(x.STOP)}, t)) as ts from text_docs)"


def _search_sql(requests: list[str]) -> str:
    """Scores of requests from the clauses' definition, over plain rows: (doc_id, keyword, score) as `hits`, term parts as `bm`."""
    words = text.request_terms(requests)
    terms = list(dict.fromkeys(w for r in words for w in r))
    values = ", ".join(f"('{t}', {text.edits(t)})" for t in terms)
    asked = ", ".join(f"('{r}', '{w}')" for r, ws in zip(requests, words, strict=True) for w in ws)
    phrases = " union all ".join(f"select doc_id, '{r}' as keyword, len(list_filter(range(1, len(ts) - {len(ws) - 2}), lambda i: ts[i:i + {len(ws) - 1}] = {ws})) as pf from tok" for r, ws in zip(requests, words, strict=True))
    return f"""st as (select count(*) as n, avg(len(ts)) as avg_dl from tok), t as (select * from (values {values}) v(term, k)), asked as (select * from (values {asked}) v(keyword, term)),
tk as (select doc_id, len(ts) as dl, unnest(ts) as token from tok), tc as (select doc_id, dl, token, count(*) as tf from tk group by all),
nr as (select doc_id, dl, term, token, tf, levenshtein(token, term) as d from tc, t where abs(length(token) - length(term)) <= k and (token = term or (k > 0 and levenshtein(token, term) <= k))),
df as (select term, count(distinct doc_id) filter (token = term) as df, count(distinct doc_id) as dfn from nr group by all), sat as (select nr.*, tf * 2.2::double / (tf + 1.2::double * (0.25 + 0.75 * dl / avg_dl)) as s, ln(1 + (n - df + 0.5) / (df + 0.5)) as idf, ln(1 + (n - dfn + 0.5) / (dfn + 0.5)) as idfn from nr join df using (term), st),
bm as (select doc_id, term, tf, idf * s as score from sat where token = term), fz as (select doc_id, term, idfn * sum((1 - d / least(length(token), length(term))::double) * s) as score from sat group by doc_id, term, idfn),
own as (select distinct keyword, term from asked), ph as ({phrases}),
rare as (select keyword, sum(ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5))) as rare from asked left join df using (term), st group by all),
ex as (select keyword, doc_id, sum(score) as exact, count(*) as held from own join bm using (term) group by all), fu as (select keyword, doc_id, sum(score) as fuzzy from own join fz using (term) group by all), nt as (select keyword, count(*) as nt from own group by all),
hits_t as (select doc_id, keyword, coalesce(case when pf > 0 then 8 * rare * (pf * 2.2::double / (pf + 1.2::double * (0.25 + 0.75 * len(ts) / avg_dl))) end, 0) + coalesce(case when held = nt then 5 * exact end, 0) + coalesce(case when held >= greatest(1, floor(0.6 * nt)) then 3 * exact end, 0) + 2 * coalesce(fuzzy, 0) as score
  from ph join nt using (keyword) join rare using (keyword) join tok using (doc_id) left join ex using (keyword, doc_id) left join fu using (keyword, doc_id), st)"""


WORDS3 = "from he la"
SEARCH = f"with {fx.DOCS_SQL}, {fx.FRAMES_SQL}, {TOK}, {_search_sql([WORDS3])}, hits as (select doc_id, score from hits_t where score > 0)"


@query(f"with {fx.DOCS_SQL}, {TOK}, {_search_sql(['from', 'he', 'la'])} select doc_id, term, tf, round(score, 5) as score from bm")
def T1_bm25(spark, sf):
    return text.bm25(fx.text_docs(spark, sf), ["from", "he", "la"]).select("doc_id", "term", F.col("tf").cast("long"), F.round("score", 5).alias("score"))


@query(f"{SEARCH} select doc_id, round(score, 5) as score from hits")
def T1_text_search(spark, sf):
    return text.search(fx.text_docs(spark, sf), WORDS3).select("doc_id", F.round("score", 5).alias("score"))


@query(f"with {fx.DOCS_SQL}, {TOK} select doc_id, len(ts) as n_tokens, md5(array_to_string(ts, ' ')) as tokens_md5 from tok")
def T2_analyzer(spark, sf):
    d = fx.text_docs(spark, sf).select("doc_id", x.tokens(F.col("text")).alias("ts"))
    return d.select("doc_id", F.size("ts").cast("long").alias("n_tokens"), F.md5(F.array_join("ts", " ")).alias("tokens_md5"))


@query(f"{SEARCH} select doc_id from (select doc_id, row_number() over (order by round(score, 6) desc, doc_id) as rank from hits) where rank <= 20")
def T3_search_ids(spark, sf):
    return text.search(fx.text_docs(spark, sf), WORDS3, 20).select("doc_id")


@query(f"{SEARCH} select h.doc_id, frame_id, video_id, timestamp_sec, round(score, 5) as score from hits h join text_docs using (doc_id) join frames using (frame_id) where source = 'ocr'")
def T4_ocr_search(spark, sf):
    d = fx.text_docs(spark, sf)
    h = text.frame_hits(text.search(d, WORDS3, keep=("source", "frame_id")).where("source = 'ocr'"), fx.frames(spark, sf))
    return h.select("doc_id", "frame_id", "video_id", "timestamp_sec", F.round("score", 5).alias("score"))


ALNUM, SEEN = "length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g'))", "length(regexp_replace(text, '[\\t-\\r\\x1c-\\x20\\x{85}\\p{Z}]', '', 'g'))"
QUALITY = f"case when {SEEN} = 0 then 0 else {ALNUM} / {SEEN} * least(1.0, {ALNUM} / case source when 'ocr' then 6 else 12 end) end"


@query(f"with {fx.DOCS_SQL} select doc_id, round({QUALITY}, 6)::double as quality from text_docs")
def T9_document_quality(spark, sf):
    return fx.text_docs(spark, sf).select("doc_id", r6(text.quality(F.col("source"), F.col("text"))).alias("quality"))


#: Requests of keywords: on screen, in speech, and both at once (accents and case apart, "La" is "la").
JOINT = text.joint_request(("from he", "la", "zebra quagga"), ("Là", "there is", "la "), {"ocr": 0.4, "asr": 0.7})
ASKED = [("ocr", ("from he", "la", "zebra quagga"), ("ocr",)), ("asr", ("La", "there is"), ("asr",)), ("joint", JOINT[0], ("ocr", "asr"))]
WORDS_ALL = list(dict.fromkeys(k for _, ks, _ in ASKED for k in ks))
POOL = 200
KEYWORDS = f"""with {fx.DOCS_SQL}, {TOK}, {_search_sql(WORDS_ALL)}, rq as (select * from (values {", ".join(f"('{n}', '{k}', '{s}')" for n, ks, ss in ASKED for k in ks for s in ss)}) v(request, keyword, source)),
q as (select doc_id, source, frame_id, {QUALITY} as quality, trim(regexp_replace(strip_accents(lower(text)), '\\s+', ' ', 'g')) as folded from text_docs),
kh as (select request, keyword, doc_id, score, row_number() over (partition by request, keyword order by round(score, 6) desc, doc_id) as n from hits_t join text_docs using (doc_id) join rq using (keyword, source) where score > 0),
kw as (select kh.*, source, frame_id, quality, contains(folded, strip_accents(lower(keyword))) as exact_phrase from kh join q using (doc_id) where n <= {POOL} and quality > 0),
kn as (select *, strip_accents(lower(keyword)) as semantic, case when max(score) over w - min(score) over w <= 1e-9 then 1 else (score - min(score) over w) / (max(score) over w - min(score) over w) end * quality as c from kw window w as (partition by request, keyword)),
kg as (select request, frame_id, max(c) as best, count(distinct semantic) as n_keywords, avg(quality) as avg_quality from kn group by all),
ke as (select * from (select *, best * (1 + 0.2 * (n_keywords - 1)) as score, row_number() over (partition by request order by round(best * (1 + 0.2 * (n_keywords - 1)), 9) desc, frame_id) as rank from kg) where rank <= {POOL}),
kc as (select request, count(distinct strip_accents(lower(keyword))) as asked from rq group by all), km as (select request, count(distinct semantic) as met from kn group by all),
kt as (select request, max(score) as best, quantile_cont(score, 0.5) as med, count(*) as n, avg(avg_quality) as quality from ke where rank <= 10 group by all),
kq as (select request, coalesce(met, 0) / asked as coverage, case when n is null then 0 when n = 1 then 1 else greatest(0, least(1, (best - med) / greatest(abs(best), 1e-9))) end as separation, coalesce(quality, 0) as quality from kc left join km using (request) left join kt using (request)),
hq as (select *, 0.5 * coverage + 0.3 * separation + 0.2 * quality as hit_quality from kq)"""


def _keyword_hits(spark, sf):
    return text.keyword_hits(fx.text_docs(spark, sf), ASKED, POOL)


@query(f"{KEYWORDS} select request, frame_id, n_keywords, rank, round(score, 6) as score from ke")
def T7_keyword_evidence(spark, sf):
    """Of each request's keywords the best two hundred documents, and as many frames (both features)."""
    return text.keyword_evidence(_keyword_hits(spark, sf), POOL).select("request", "frame_id", "n_keywords", "rank", r6("score").alias("score"))


def _quality(spark, sf):
    h = _keyword_hits(spark, sf)
    asked = spark.createDataFrame([(n, k) for n, ks, _ in ASKED for k in ks], "request string, keyword string")
    return text.hit_quality(h, text.keyword_evidence(h, POOL), asked, ["request"])


@query(f"{KEYWORDS} select request, round(coverage, 6) as coverage, round(separation, 6) as separation, round(hit_quality, 6) as hit_quality from hq")
def T10_hit_quality(spark, sf):
    return _quality(spark, sf).select("request", *[r6(c).alias(c) for c in ("coverage", "separation", "hit_quality")])


@query(f"""{KEYWORDS} select source, count(distinct frame_id) as n_frames, 'used' as status, round(least(0.5, greatest(0, 0.7 * any_value(hit_quality))), 6)::double as weight from kn join hq using (request) where request = 'joint' group by all""")
def T12_joint_text(spark, sf):
    """Both sources by one list of keywords: frames hit by each, and the weight by the larger confidence."""
    h = _keyword_hits(spark, sf).where("request = 'joint'")
    counts = h.groupBy("request", "source").agg(F.countDistinct("frame_id").alias("n_frames"))
    j = counts.join(_quality(spark, sf), "request").withColumn("weight", fusion.adaptive_weight(F.lit(JOINT[1]), F.col("hit_quality")))
    return j.select("source", "n_frames", F.when((F.col("n_frames") > 0) & (F.col("weight") > 0), "used").otherwise("no_hits").alias("status"), "weight")


@query(f"""with recursive {fx.POINTS_SQL}, o as (select kind, video_id, event_id, ts, row_number() over (partition by kind, video_id order by event_id) as i from points),
walk as (select kind, video_id, 0::bigint as i, []::double[] as kept, null::bigint as event_id, false as keep from o where i = 1
  union all select o.kind, o.video_id, o.i, case when len(list_filter(w.kept, lambda k: abs(k - o.ts) <= 3600)) = 0 then list_append(w.kept, o.ts) else w.kept end, o.event_id, len(list_filter(w.kept, lambda k: abs(k - o.ts) <= 3600)) = 0 from walk w join o on o.kind = w.kind and o.video_id = w.video_id and o.i = w.i + 1)
select kind as keyword, video_id, event_id as doc_id from walk where keep""")
def T8_near_suppression(spark, sf):
    """Greedy in rank order; tested against a loop too."""
    p = fx.points(spark, sf).select(F.col("kind").alias("keyword"), "video_id", F.lit(0).alias("shot_id"), F.lit("").alias("norm"), "ts", F.col("event_id").alias("rank"), F.col("event_id").alias("doc_id"))
    return text.suppress_near(p, 3600.0).select("keyword", "video_id", "doc_id")


@query(f"{SEARCH} select frame_id, round(max(score), 5) as score from (select * from hits order by round(score, 6) desc, doc_id limit 5000) join text_docs using (doc_id) group by all")
def T11_score_map(spark, sf):
    """Of the best five thousand documents (the feature) the best score of each frame."""
    d = fx.text_docs(spark, sf)
    return text.search(d, WORDS3, 5000, ("frame_id",)).groupBy("frame_id").agg(F.round(F.max("score"), 5).alias("score"))


EVIDENCE = f"""{KEYWORDS}, {fx.FRAMES_SQL}, {fx.VECTORS_SQL}, {fx.QUERIES_SQL}, {SCORED}, {SRRF} {RANKED}, co as (select request as component, frame_id, case when max(score) over w - min(score) over w <= 1e-9 then 1 else (score - min(score) over w) / (max(score) over w - min(score) over w) end as normalized from ke where request <> 'joint' window w as (partition by request)),
ax as (select frame_id, max(normalized * w) as best_aux, sum(normalized * w) as all_aux, count(*) as n_aux from co join (values ('ocr', 0.4::double), ('asr', 0.25::double)) v(component, w) using (component) group by all),
er as (select *, row_number() over (partition by request, frame_id order by keyword, round(score, 6) desc, doc_id) as e from kw where request <> 'joint'), ev as (select frame_id, max(quality * case when exact_phrase then 1.0 else 0.8 end) as worth from er where e <= 8 group by all),
ne as (select r.*, rank <= 30 as head, case when rank <= 30 and worth is not null and best_aux is not null then r.score + 0.20 * best_aux * worth + 0.02 * least(1, n_aux / 3) * all_aux else r.score end as new from r left join ax using (frame_id) left join ev using (frame_id))"""


@query(f"{EVIDENCE} select query_id, frame_id, row_number() over (partition by query_id order by head desc, case when head then -round(new, 9) else 0 end, rank) as place, round(new / max(new) over (partition by query_id), 6) as score from ne")
def F8_evidence_rerank(spark, sf):
    """Visual results with what the text branches found; the evidence of all documents, eight rows of a frame and branch (the feature)."""
    h = _keyword_hits(spark, sf).where("request <> 'joint'")
    branch = fusion.diagnostics(text.keyword_evidence(h, POOL).select("request", "frame_id", "score"), ["request"])
    components = branch.select(F.col("request").alias("component"), "frame_id", "normalized")
    ev = text.evidence_rows(h).select("frame_id", F.col("quality").alias("document_quality"), F.col("weight").alias("temporal_weight"), "exact_phrase")
    out = fusion.evidence_rerank(_ranked(spark, sf).select("query_id", "frame_id", "rank", "score"), components, {"kis": 1.0, "ocr": 0.4, "asr": 0.25}, ev, ["query_id"])
    return out.select("query_id", "frame_id", "place", r6("score").alias("score"))


#: Required events of a request and what captions are searched for: the short variant of each language.
CAPTION_EVENTS = (("woman placing 4 [TARGET] from he la", "đặt lên đĩa 4 con [TARGET] la from"), ("then holding 2 [TARGET] there", "cầm 2 con [TARGET] la"))
CAPTION_TEXTS = ("4 food ingredients from he la", "4 nguyen lieu mon an la from tren dia trang", "2 food ingredients there in hands", "2 nguyen lieu mon an la tren tay")
CAPTIONS = f"""with {fx.DOCS_SQL.replace("from documents", "from documents where doc_id % 2 = 1")}, {fx.FRAMES_SQL}, {fx.VECTORS_SQL}, {fx.QUERIES_SQL}, {TOK}, {_search_sql(list(CAPTION_TEXTS))}, {SCORED}, {SRRF} {RANKED},
cl as (select *, row_number() over (partition by keyword order by round(score, 6) desc, doc_id) as rank from hits_t where score > 0), cf as (select keyword, frame_id, min(rank) as first from cl join text_docs using (doc_id) where rank <= {POOL} group by all),
ck as (select keyword, frame_id, row_number() over (partition by keyword order by first) as rank, count(*) over (partition by keyword) as n from cf),
v as (select query_id, frame_id, case when n <= 1 then 1.0::double else greatest(0, 1 - (rank - 1) / n) end as s from (select *, count(*) over (partition by query_id) as n from r)),
a as (select q.query_id, frame_id, 0.2 * case when n <= 1 then 1.0::double else greatest(0, 1 - (rank - 1) / n) end as s from ck, (select distinct query_id from queries) q)
select query_id, frame_id, round(sum(s), 6) as score from (select * from v union all select * from a) group by all"""


@query(CAPTIONS)
def T13_caption_retrieval(spark, sf):
    """Captions by the short search texts of required events, each a list that raises the visual results."""
    events = spark.createDataFrame(list(CAPTION_EVENTS), "en string, vi string")
    food, yes = F.lit("food"), F.lit(True)
    made = events.select(lang.caption_queries(lang.event_variants(F.col("en"), "en", food, yes), lang.event_variants(F.col("vi"), "vi", food, yes)).alias("q"))
    texts = list(dict.fromkeys(t for r in made.collect() for t in r.q))  # two for each of at most five events
    captions = fx.text_docs(spark, sf).where("source = 'asr'")
    found = ranking.top_per(text.search_many(captions, texts, keep=("frame_id",)), ["keyword"], [F.desc(F.round("score", 6)), "doc_id"], POOL)
    frames = found.groupBy("keyword", "frame_id").agg(F.min("rank").alias("first"))
    lists = ranking.ranked(frames, ["keyword"], ["first"]).withColumnRenamed("keyword", "source")
    r = _ranked(spark, sf)
    return fusion.auxiliary_merge_shared(r, lists, ["query_id"]).select("query_id", "frame_id", r6("score").alias("score"))
