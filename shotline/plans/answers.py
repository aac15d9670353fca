"""Verdicts and answers against what was retrieved."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shotline.functions import scalar as x
from shotline.operators import answers, ranking
from shotline.plans.registry import query
from shotline.plans.retrieval import HEAD, RANKED, SCORED, SRRF, _ranked
from shotline.plans.scalars import WORDS
from shotline.sources import fixtures as fx

r6 = lambda c: F.round(c, 6)
REQUIRED = [0, 1]
# Replies as tables, from the events of a user (a candidate): frames shown are its six strongest views and clicks, labelled F1 to F6;
# purchases claim that a label shows an event; sign-ups are the verdict, then observations of the events.
KINDS = ("food", "object", "person", "food")
ANSWERS = ("Clam", "the clams", "a red clam", "shrimp", "", "The woman")
K = fx.K_SQL
REPLIES_SQL = f"""shown as (select user_id as candidate_id, 'F' || row_number() over (partition by user_id order by value desc, event_id) as label, case event_type when 'view' then 0 else 1 end as event_index, event_id as frame_id,
  case when {K} <> 7 then epoch_us(ts) / 1e6 end as ts, row_number() over (partition by user_id order by value desc, event_id) as n from events where event_type in ('view', 'click')), labels_of as (select * from shown where n <= 6),
claims as (select distinct user_id as candidate_id, {K} % 3 as event_index, 'F' || (1 + {K} % 8) as label from events where event_type = 'purchase'), cands as (select distinct user_id as candidate_id from events),
su as (select *, {K} as k, row_number() over (partition by user_id order by event_id) as n from events where event_type = 'signup'),
reply as (select c.candidate_id, case when k < 60 then 'Supported' when k < 90 then 'partial' else 'unsure' end as verdict, case when k is null then null else {list(ANSWERS)}[k % 6 + 1] end as answer, {list(KINDS)}[coalesce(k, 0) % 4 + 1] as entity,
  least(1.0::double, value / 30) as confidence, k % 7 = 0 as says_contradiction from cands c left join (select * from su where n = 1) s on s.user_id = c.candidate_id),
obs as (select user_id as candidate_id, n - 2 as event_index, {list(ANSWERS)}[k % 6 + 1] as target, k % 5 as visible_count, k % 2 = 0 as on_plate, k % 3 <> 0 as held, 'F' || (1 + k % 6) as label from su where n in (2, 3))"""
SPECS = (("TARGET_ENTITY_TYPE", "entity_type", None, "food"), ("E0_COUNT_2", "count", 0, "2"), ("E0_ON_PLATE", "relation", 0, "on_plate"), ("E1_HELD", "action", 1, "held"), ("TARGET_SAME_IDENTITY_0_1", "same_identity", None, "0_1"), ("ORDER_0_1", "order", None, "0_1"))
SPECS_SQL = "specs as (select * from (values " + ", ".join(f"('{a}', '{b}', {'null' if c is None else c}::int, '{d}', {i})" for i, (a, b, c, d) in enumerate(SPECS)) + ") t(constraint_id, kind, event_index, value, i))"
CITED_SQL = f"""{REPLIES_SQL}, ok as (select distinct c.candidate_id, event_index, label, frame_id, ts from claims c join labels_of using (candidate_id, label, event_index)), per as (select candidate_id, event_index, min(ts) as ts from ok group by all),
cov as (select candidate_id, count(distinct event_index) filter (event_index in (0, 1)) / 2 as coverage, min(ts) filter (event_index = 0) as t0, min(ts) filter (event_index = 1) as t1, array_to_string(list_sort(list(distinct event_index)), ',') as matched,
  array_to_string(list_sort(list(distinct frame_id)), ',') as frames from ok group by all), cited as (select c.candidate_id, coalesce(coverage, 0.0) as coverage, coalesce(t0 < t1, true) as ordered, coalesce(matched, '') as matched, coalesce(frames, '') as frames from cands c left join cov using (candidate_id))"""


def _of(c: str) -> str:
    """The tokens of a label in SQL."""
    words = f"list_filter(string_split({WORDS.format(c=c)}, ' '), lambda t: t <> '' and t not in ({', '.join(repr(t) for t in dict.fromkeys(x.GENERIC_LABELS))}))"
    return f"list_sort(list_distinct(list_transform({words}, lambda t: case when length(t) > 3 and t[-1] = 's' and t[-2] <> 's' then t[1:length(t) - 1] else t end)))"


MET_SQL = f"""{CITED_SQL}, {SPECS_SQL}, okobs as (select o.* from obs o join ok using (candidate_id, event_index, label) where len({_of('target')}) > 0),
ident as (select c.candidate_id, count(o.target) = 2 and bool_and({_of('o.target')} = {_of('r.answer')}) and any_value(len({_of('r.answer')})) > 0 as identity from cands c join reply r using (candidate_id) left join okobs o on o.candidate_id = c.candidate_id and o.event_index in (0, 1) group by all),
conf as (select candidate_id, answer, entity, verdict, confidence, says_contradiction, entity in ('person') or regexp_matches(' ' || {WORDS.format(c="coalesce(answer, '')")} || ' ', ' (person|woman|man|human|nguoi|phu nu|co gai|nu mc) ') as conflict from reply),
j as (select c.candidate_id, s.*, coalesce(case s.kind when 'entity_type' then (entity = s.value) and not conflict when 'order' then cited.ordered and cited.coverage >= 1 when 'same_identity' then identity when 'count' then o.visible_count = s.value::int
  when 'relation' then o.on_plate when 'action' then o.held end, false) and (c.candidate_id + s.i) % 5 <> 0 as met from conf c cross join specs s join cited on cited.candidate_id = c.candidate_id join ident on ident.candidate_id = c.candidate_id left join okobs o on o.candidate_id = c.candidate_id and o.event_index = s.event_index),
met as (select candidate_id, count(*) as n_specs, coalesce(string_agg(constraint_id, ',' order by constraint_id) filter (met), '') as met, count(*) filter (met and kind <> 'entity_type') / 5 as constraint_coverage from j group by all)"""


def _replies(spark, sf):
    """shown labels, claims, candidates, replies and observations; see above."""
    e = fx.table(spark, sf, "events").withColumn("k", fx.k_of("props")).withColumnRenamed("user_id", "candidate_id")
    at = F.when(F.col("k") != 7, F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    of = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    shown = ranking.ranked(e.where("event_type in ('view', 'click')"), ["candidate_id"], [F.desc("value"), "event_id"], "n").where("n <= 6")
    shown = shown.select("candidate_id", F.concat(F.lit("F"), "n").alias("label"), F.when(F.col("event_type") == "view", 0).otherwise(1).alias("event_index"), F.col("event_id").alias("frame_id"), at.alias("ts"))
    claims = e.where("event_type = 'purchase'").select("candidate_id", (F.col("k") % 3).alias("event_index"), F.concat(F.lit("F"), 1 + F.col("k") % 8).alias("label"))
    cands = e.select("candidate_id").distinct()
    su = ranking.ranked(e.where("event_type = 'signup'"), ["candidate_id"], ["event_id"], "n").where("n <= 3")
    verdict = F.when(F.col("k") < 60, "Supported").when(F.col("k") < 90, "partial").otherwise("unsure")
    first = su.where("n = 1").select("candidate_id", "k", verdict.alias("v"), of(ANSWERS, F.col("k") % 6).alias("answer"), F.least(F.lit(1.0), F.col("value") / 30).alias("confidence"))
    reply = cands.join(first, "candidate_id", "left")
    reply = reply.select("candidate_id", F.coalesce("v", F.lit("unsure")).alias("verdict"), "answer", of(KINDS, F.coalesce("k", F.lit(0)) % 4).alias("entity"), "confidence", F.when(F.col("k") % 7 == 0, 1).otherwise(0).alias("contradictions"))
    k = F.col("k")
    obs = su.where("n in (2, 3)").select("candidate_id", (F.col("n") - 2).alias("event_index"), of(ANSWERS, k % 6).alias("target"), (k % 5).alias("visible_count"), (k % 2 == 0).alias("on_plate"), (k % 3 != 0).alias("held"), F.concat(F.lit("F"), 1 + k % 6).alias("label"))
    return shown, claims, cands, reply, obs


def _cited(spark, sf):
    shown, claims, cands, _, _ = _replies(spark, sf)
    return answers.cited(cands, claims, shown, REQUIRED)


@query(f"with {CITED_SQL} select candidate_id, coverage, ordered, matched, frames from cited")
def R1_citations(spark, sf):
    """Claimed labels count where they are listed and show the event; then coverage and order of the required events."""
    return _cited(spark, sf).select("candidate_id", "coverage", "ordered", F.array_join("matched", ",").alias("matched"), F.array_join("frames", ",").alias("frames"))


def _grounded(spark, sf):
    """Replies with citations, valid observations, identity and constraints."""
    shown, claims, cands, reply, obs = _replies(spark, sf)
    cited = answers.cited(cands, claims, shown, REQUIRED)
    valid = claims.distinct().join(shown, ["candidate_id", "label", "event_index"]).select("candidate_id", "label", "event_index").distinct()
    seen = obs.join(valid, ["candidate_id", "event_index", "label"], "left_semi").where(F.size(x.label_tokens(F.col("target"))) > 0)
    targets = seen.where(F.col("event_index").isin(*REQUIRED)).groupBy("candidate_id").agg(F.collect_list("target").alias("targets"))
    g = reply.join(cited, "candidate_id").join(targets, "candidate_id", "left").withColumn("targets", F.coalesce("targets", F.array().cast("array<string>")))
    same = answers.identity_consistent(F.col("targets"), len(REQUIRED), F.col("answer"), F.coalesce("answer", F.lit("")))
    g = g.withColumn("identity", F.coalesce(same, F.lit(False))).withColumn("type_conflict", answers.type_conflict(F.lit("food"), F.col("entity"), F.col("answer")))
    specs = spark.createDataFrame([(a, b, c, d, i) for i, (a, b, c, d) in enumerate(SPECS)], "constraint_id string, kind string, event_index int, value string, i int")
    said = cands.crossJoin(F.broadcast(specs.select("constraint_id", "i"))).where((F.col("candidate_id") + F.col("i")) % 5 != 0).drop("i")  # six constraints
    return g, answers.constraints_met(g, specs.drop("i"), said, seen)


@query(f"with {MET_SQL} select candidate_id, n_specs, met, round(constraint_coverage, 6) as constraint_coverage from met")
def R2_constraints(spark, sf):
    return _grounded(spark, sf)[1].select("candidate_id", "n_specs", "met", r6("constraint_coverage").alias("constraint_coverage"))


@query(f"""with {MET_SQL}, ret as (select candidate_id, count(distinct event_index) / 2 as retrieved from labels_of group by all),
r as (select c.*, coalesce(retrieved, 0) as retrieved, cited.coverage, ordered, frames, identity, constraint_coverage, case when lower(verdict) in ('supported', 'partial', 'not_supported') then lower(verdict) else 'partial' end as v
  from conf c left join ret using (candidate_id) join cited using (candidate_id) join ident using (candidate_id) join met using (candidate_id))
select candidate_id, case when conflict or retrieved < 1 then 'not_supported' when v = 'supported' and (frames = '' or coalesce(answer, '') = '' or coverage < 1 or not ordered or not coalesce(identity, false) or constraint_coverage < 1 or coalesce(says_contradiction, false)) then 'partial' else v end as verdict,
  round(least(coalesce(confidence, 0), 0.5 * retrieved + 0.3 * constraint_coverage + 0.2 * coverage), 6) as confidence from r""")
def R3_verdicts(spark, sf):
    return _verified(spark, sf).select("candidate_id", "verdict", r6("confidence").alias("confidence"))


def _verified(spark, sf):
    shown = _replies(spark, sf)[0]
    g, met = _grounded(spark, sf)
    retrieved = shown.groupBy("candidate_id").agg((F.countDistinct("event_index") / len(REQUIRED)).alias("retrieved"))
    rows = g.join(met.select("candidate_id", "constraint_coverage"), "candidate_id").join(retrieved, "candidate_id", "left").withColumn("retrieved", F.coalesce("retrieved", F.lit(0.0)))
    return answers.verdicts(rows.withColumn("needs_identity", F.lit(True)), len(REQUIRED))


# A judge's final answer on each candidate: the error events of its user, in order: the first is the answer, the next four the citations.
JUDGE_SQL = f"""{REPLIES_SQL}, er as (select *, {K} as k, row_number() over (partition by user_id order by event_id) as n from events where event_type = 'error'),
ji as (select user_id as request, case when k % 10 < 8 then 'answered' else 'insufficient_evidence' end as status, case when k % 9 = 0 then user_id + 1 else user_id end as selected_id, least(1.0::double, value / 10) as confidence from er where n = 1),
cites as (select e.user_id as request, l.frame_id, l.candidate_id as owner, l.event_index from er e join labels_of l on l.candidate_id = e.user_id and l.label = 'F' || (1 + e.k % 6) where e.n between 2 and 7),
ca as (select request, count(*) as n, bool_and(owner = selected_id) as owned, bool_or(event_index = 0) and bool_or(event_index = 1) as each_event from cites join ji using (request) group by all),
vr as (select candidate_id, answer, least(1.0::double, coalesce(confidence, 0) * 2) as confidence from reply),
o as (select request, count(distinct event_index) = 2 and bool_and(f and same) as observed from (select ji.request, obs.event_index, exists(select 1 from cites c join labels_of l on l.candidate_id = obs.candidate_id and l.label = obs.label where c.request = ji.request and c.frame_id = l.frame_id and c.owner = ji.selected_id and c.event_index = obs.event_index) as f,
  len({_of('target')}) > 0 and {_of('target')} = {_of("coalesce(answer, '')")} as same from ji join obs on obs.candidate_id = ji.request join reply on reply.candidate_id = ji.request) group by all),
z as (select ji.request, status = 'answered' and selected_id = ji.request and coalesce(v.answer, '') <> '' and least(ji.confidence, coalesce(v.confidence, 0)) >= 0.65 and coalesce(n, 0) > 0 and owned and each_event and (ji.request % 2 = 0 or coalesce(observed, false)) as ok, least(ji.confidence, coalesce(v.confidence, 0)) as c
  from ji left join vr v on v.candidate_id = ji.request left join ca using (request) left join o using (request))"""


@query(f"with {JUDGE_SQL} select request, coalesce(ok, false) as accepted, round(case when coalesce(ok, false) then c else 0 end, 6) as confidence from z")
def R4_acceptance(spark, sf):
    """Every second request asks for one identity in all required events; the judge repeats the verdict's answer."""
    shown, _, _, reply, obs = _replies(spark, sf)
    er = ranking.ranked(fx.table(spark, sf, "events").where("event_type = 'error'").withColumn("k", fx.k_of("props")), ["user_id"], ["event_id"], "n").where("n <= 7")
    status = F.when(F.col("k") % 10 < 8, "answered").otherwise("insufficient_evidence")
    judge = er.where("n = 1").select(F.col("user_id").alias("request"), status.alias("status"), F.when(F.col("k") % 9 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("selected_id"), F.least(F.lit(1.0), F.col("value") / 10).alias("confidence"))
    cites = er.where("n between 2 and 7").select(F.col("user_id").alias("candidate_id"), F.concat(F.lit("F"), 1 + F.col("k") % 6).alias("label")).distinct().join(shown, ["candidate_id", "label"])
    cites = cites.groupBy(F.col("candidate_id").alias("request")).agg(F.collect_list(F.struct("frame_id", F.col("candidate_id").alias("owner"), F.array("event_index").alias("events"))).alias("cited"))
    seen = obs.join(shown.select("candidate_id", "label", "frame_id"), ["candidate_id", "label"], "left")
    row = F.struct("event_index", F.col("target").alias("label"), F.col("target").alias("chosen_label"), F.array_compact(F.array("frame_id")).alias("frames"))
    seen = seen.groupBy(F.col("candidate_id").alias("request")).agg(F.collect_list(row).alias("observations"))
    chosen = reply.select(F.col("candidate_id").alias("request"), "answer", F.col("answer").alias("chosen_answer"), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0)) * 2).alias("chosen_confidence"))
    j = judge.join(chosen, "request", "left").join(cites, "request", "left").join(seen, "request", "left")
    j = j.select("*", F.col("request").alias("chosen_id"), (F.col("request") % 2 == 1).alias("needs_identity"), F.lit(True).alias("chosen_identity"), F.lit(None).cast("string").alias("canonical"))
    return answers.accepted(j, REQUIRED).select("request", "accepted", r6("confidence").alias("confidence"))


# Display: candidates are the request's best hit of each of its first ten videos; verdicts come from labels.
DISPLAY_SQL = f"""{HEAD} {SCORED}, {SRRF} {RANKED}, e as (select vec_id as frame_id, label from embeddings), v as (select query_id, video_id, min(rank) as first from r group by all), c as (select query_id, video_id, row_number() over (partition by query_id order by first) as id from v),
ev as (select query_id, id, c.video_id, max(r.score) as score, list(r.frame_id order by r.rank) as frames, list(r.frame_id order by r.rank) filter (e.label % 2 = 0) as cited, bool_or(e.label = 3) as supported from c join r using (query_id, video_id) join e using (frame_id) where id <= 10 group by all),
d as (select *, row_number() over (partition by query_id order by id = 4 desc, supported desc, score desc, id) as o, coalesce(cited[1], frames[1]) as frame_id from ev),
u as (select query_id, 0 as tail, o as k, frame_id, id::bigint as candidate_id from d union all select query_id, 1, rank, frame_id, null from r),
w as (select *, row_number() over (partition by query_id, frame_id order by tail, k) as n from u)
select * from (select query_id, row_number() over (partition by query_id order by tail, k) as place, frame_id, candidate_id from w where n = 1) where place <= 40"""


@query(DISPLAY_SQL)
def L7_display_list(spark, sf):
    """Selected, supported, other candidates with a cited frame each, then the results; forty rows (the feature)."""
    r = _ranked(spark, sf).join(fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_id"), "label"), "frame_id")
    per = r.groupBy("query_id", "video_id").agg(
        F.min("rank").alias("first"), F.max("score").alias("score"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "frame_id"))), lambda v: v["frame_id"]).alias("evidence"),
        F.collect_list(F.when(F.col("label") % 2 == 0, F.col("frame_id"))).alias("frames"), F.bool_or(F.col("label") == 3).alias("on"),
    )
    c = per.withColumn("candidate_id", F.row_number().over(Window.partitionBy("query_id").orderBy("first")).cast("long")).where("candidate_id <= 10")
    verdicts = c.select("query_id", "candidate_id", F.when(F.col("on"), "supported").otherwise("partial").alias("verdict"), "frames")
    candidates = c.select("query_id", "candidate_id", "video_id", "score", (F.col("candidate_id") == 4).alias("selected"), "evidence")
    return ranking.display_list(candidates, verdicts, r, ["query_id"], 40).select("query_id", "place", "frame_id", "candidate_id")
