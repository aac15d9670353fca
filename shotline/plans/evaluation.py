"""Aggregates, set operations, quality gates, metrics and answer rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shotline.functions import scalar as x
from shotline.operators import evaluate, fusion, quality, temporal
from shotline.plans.joins import INTERVALS, MAPPED, _lacking, _video_frames
from shotline.plans.registry import query
from shotline.plans.retrieval import HEAD, SCORED, _hits
from shotline.plans.scalars import CASED, PATHS, SQZ, _paths
from shotline.sources import fixtures as fx
from shotline.sources import store

r6 = lambda c: F.round(c, 6)


@query(f"with {fx.FRAMES_SQL} select shot_id, string_agg(frame_id::varchar, ',' order by timestamp_sec, frame_id) as frame_ids, count(*) as n from frames group by all")
def A1_collect(spark, sf):
    g = fx.frames(spark, sf).groupBy("shot_id").agg(F.array_sort(F.collect_list(F.struct("timestamp_sec", "frame_id"))).alias("f"), F.count("*").alias("n"))
    return g.select("shot_id", F.array_join(F.col("f.frame_id").cast("array<string>"), ",").alias("frame_ids"), "n")


LINES = "regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0B\\f\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]')"


@query(f"""with {fx.DOCS_SQL}, d as (select doc_id, {LINES} as ls from text_docs where source = 'ocr'), l as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as pos from d), n as (select *, lower({SQZ.format(c='line')}) as norm from l),
c as (select norm from n where norm <> '' group by norm having count(distinct doc_id) >= (select greatest(2, floor(count(*) * 0.01)) from d))
select doc_id, string_agg(line, chr(10) order by pos) as text from n where norm <> '' and norm not in (select norm from c) group by doc_id""")
def A2_common_lines(spark, sf):
    """Lines of a hundredth of the texts on screen, or more, go."""
    return quality.drop_common_lines(fx.text_docs(spark, sf).where("source = 'ocr'"), 0.01)


@query("select text_hash, count(*) as n from (select md5(text) as text_hash from documents) group by all having count(*) > 1")
def A3_duplicates(spark, sf):
    return fx.table(spark, sf, "documents").groupBy(F.md5("text").alias("text_hash")).agg(F.count("*").alias("n")).where("n > 1")


@query(f"with {fx.FRAMES_SQL}, {fx.DOCS_SQL} select source, count(*) as n_docs, count(distinct f.frame_id) as n_covered, round(count(distinct f.frame_id) / (select count(distinct frame_id) from frames)::double, 6) as share from text_docs d left join frames f using (frame_id) group by all")
def A4_coverage(spark, sf):
    return quality.coverage(fx.frames(spark, sf), fx.text_docs(spark, sf)).withColumn("share", r6("share"))


@query("select user_id, count(*) as n from events where event_type = 'view' group by all order by n desc, user_id limit 6")
def A6_top_videos(spark, sf):
    return fx.table(spark, sf, "events").where("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(6)


@query("select event_type, round(avg(value), 6) as mean_ms, round(quantile_cont(value, 0.5), 6) as p50_ms, round(quantile_cont(value, 0.95), 6) as p95_ms, count(value) as n_evaluated from events group by all")
def A7_latency(spark, sf):
    e = evaluate.latency(fx.table(spark, sf, "events").withColumnRenamed("value", "ms"), ["event_type"])
    return e.select("event_type", *[r6(c).alias(c) for c in ("mean_ms", "p50_ms", "p95_ms")], "n_evaluated")


@query("select event_type, round(avg(case when event_id % 3 = 0 then value end), 6) as mean, count(case when event_id % 3 = 0 then value end) as n_evaluated from events group by all")
def A8_mean_evaluated(spark, sf):
    v = F.when(F.col("event_id") % 3 == 0, F.col("value"))
    return fx.table(spark, sf, "events").groupBy("event_type").agg(r6(F.avg(v)).alias("mean"), F.count(v).alias("n_evaluated"))


@query(f"with {fx.JOBS_SQL} select item_id, stage, arg_max(status, step) as status, max(updated_at) as updated_at, count(*) filter (status = 'FAILED') as attempts, arg_max(coalesce(error, ''), step) as error from jobs group by all")
def A9_attempts(spark, sf):
    """Each write replaces an item's state in a stage and counts its failures."""
    return store.job_states(fx.jobs(spark, sf)).withColumn("error", F.coalesce("error", F.lit("")))


@query("""with f as (select filename[length('/root/testdata/sf0.01') + 2:] as path, size, epoch_ms(last_modified) // 1000 * 1000 as ms from read_blob('/root/testdata/sf0.01/**'))
select '.parquet' as extension, count(*) as n, sum(size)::bigint as bytes, sha256('[' || string_agg('["' || path || '",' || size || ',' || ms || ']', ',' order by path) || ']') as fingerprint from f""")
def A10_profile(spark, sf):
    """Files, bytes and a fingerprint of the folder, and the histogram of extensions (all are Parquet)."""
    files = store.entries(spark, sf, ("parquet",)).withColumn("modified_ms", F.expr("modified_ms div 1000 * 1000"))  # as finely as every file system has it
    profile = store.profile(files)
    return profile.select(F.explode("extensions").alias("extension", "n"), "bytes", "fingerprint")


@query(f"""with d as (select doc_id, string_split(text, chr(10)) as ls from documents), l as (select doc_id, trim(unnest(ls), chr(9) || chr(13) || ' ') as value, generate_subscripts(ls, 1) - 1 as pos from d), k as (select *, {SQZ.format(c=CASED.format(c='value'))} as key from l where value <> '')
select doc_id, pos, value from (select *, row_number() over (partition by doc_id, key order by pos) as n from k) where n = 1""")
def A12_distinct_first(spark, sf):
    """A document's lines, the first of those that fold to the same, in order."""
    d = fx.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "value"))
    d = d.select("doc_id", F.col("pos").cast("long").alias("pos"), F.btrim("value", F.lit(" \t\r")).alias("value")).where("value <> ''")
    w = Window.partitionBy("doc_id", x.squeezed(x.case_folded(F.col("value")))).orderBy("pos")
    return d.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


CALLS = f"""calls as (select user_id as request, event_type = 'error' as rate_limited, {fx.K_SQL} as k, value, case {fx.K_SQL} % 5 when 0 then 'none' when 1 then '-2' else ({fx.K_SQL} % 5)::varchar end as request_count,
  case when {fx.K_SQL} % 7 = 0 then '1.5' else (100 + {fx.K_SQL})::varchar end as prompt_tokens, case when event_type = 'view' then null else {fx.K_SQL}::varchar end as completion_tokens, case when {fx.K_SQL} % 11 = 0 then 'nan' else value::varchar end as cost from events)"""


@query(f"""with {CALLS} select request, sum(case when rate_limited then 2 else 1 end)::bigint as operations, sum(greatest(0, coalesce(try_cast(request_count as bigint), 0)))::bigint as http_requests, count(*) filter (rate_limited) as rate_limited, round(sum(value * 10), 3) as wait_ms,
sum(case when prompt_tokens = '1.5' then 0 else prompt_tokens::bigint end)::bigint as prompt_tokens, sum(coalesce(completion_tokens::bigint, 0))::bigint as completion_tokens, sum(k)::bigint as total_tokens, round(sum(case when cost = 'nan' then 0 else cost::double end), 4) as cost from calls group by all""")
def A13_usage(spark, sf):
    """Calls of each request with figures as text: some aren't numbers, some negative, some missing."""
    k = fx.k_of("props")
    calls = fx.table(spark, sf, "events").select(
        F.col("user_id").alias("request"), F.when(F.col("event_type") == "error", 2).otherwise(1).cast("long").alias("logical_calls"), (F.col("event_type") == "error").alias("rate_limited"),
        F.when(k % 5 == 0, "none").when(k % 5 == 1, "-2").otherwise((k % 5).cast("string")).alias("request_count"), (F.col("value") * 10).alias("wait_ms"),
        F.when(k % 7 == 0, "1.5").otherwise((100 + k).cast("string")).alias("prompt_tokens"), F.when(F.col("event_type") != "view", k.cast("string")).alias("completion_tokens"), k.cast("string").alias("total_tokens"),
        F.when(k % 11 == 0, "nan").otherwise(F.col("value").cast("string")).alias("cost"),
    )
    return evaluate.usage_totals(calls, ["request"]).withColumn("cost", F.round("cost", 4))


@query(f"{HEAD} {SCORED} select frame_id from hits where model = 'a' union select frame_id from hits where model = 'b'")
def U1_union(spark, sf):
    h = _hits(spark, sf)
    return h.where("model = 'a'").select("frame_id").union(h.where("model = 'b'").select("frame_id")).distinct()


@query(f"{HEAD} {SCORED} select 'a' as branch, count(*) as n from hits where model = 'a' union all select 'b', count(*) from hits where model = 'b'")
def U2_union_all(spark, sf):
    h = _hits(spark, sf)
    one = h.where("model = 'a'").withColumn("branch", F.lit("a"))
    return one.unionByName(h.where("model = 'b'").withColumn("branch", F.lit("b"))).groupBy("branch").agg(F.count("*").alias("n"))


@query(f"{HEAD} {SCORED} select frame_id from hits where model = 'a' intersect select frame_id from hits where model = 'b'")
def U3_intersection(spark, sf):
    h = _hits(spark, sf)
    return h.where("model = 'a'").select("frame_id").intersect(h.where("model = 'b'").select("frame_id"))


@query(f"{HEAD} {SCORED} select distinct frame_id from hits where model = 'a' except select frame_id from hits where model = 'b'")
def U4_difference(spark, sf):
    h = _hits(spark, sf)
    return h.where("model = 'a'").select("frame_id").distinct().join(h.where("model = 'b'"), "frame_id", "left_anti")


@query("""with v as (select label % 3 as part, 'a' as model, vec_id from embeddings where label <> 5 union all select label % 3, 'b', vec_id from embeddings where label <> 3)
select part, not exists (select 1 from ((select vec_id from v a where a.model = 'a' and a.part = p.part except select vec_id from v b where b.model = 'b') union all (select vec_id from v b where b.model = 'b' and b.part = p.part except select vec_id from v a where a.model = 'a'))) as equal from (select distinct part from v) p""")
def U5_equality(spark, sf):
    """Whether two models have the same frames, for each third of the labels."""
    part = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_id"), (F.col("label") % 3).alias("part"))
    v = _lacking(spark, sf).join(part, "frame_id")
    odd = fusion.aligned(v).join(part, "frame_id").select("part").distinct().withColumn("odd", F.lit(True))
    return v.select("part").distinct().join(odd, "part", "left").select("part", F.col("odd").isNull().alias("equal"))


@query("with s as (select user_id, list(distinct event_type) filter (event_id % 2 = 0) as a, list(distinct event_type) filter (event_id % 2 = 1) as b from events group by all) select user_id, round(len(list_intersect(coalesce(a, []), coalesce(b, []))) / len(list_distinct(list_concat(coalesce(a, []), coalesce(b, []))))::double, 6) as jaccard from s")
def U6_jaccard(spark, sf):
    from shotline.functions.scalar import jaccard

    e = fx.table(spark, sf, "events")
    g = e.groupBy("user_id").agg(F.collect_set(F.when(F.col("event_id") % 2 == 0, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("event_id") % 2 == 1, F.col("event_type"))).alias("b"))
    return g.select("user_id", r6(jaccard(F.col("a"), F.col("b"))).alias("jaccard"))


# Manifests with faults that follow from the data: each kind of row is derived from columns of its own.
MANIFESTS = f"""with {PATHS.split(chr(10))[0].removesuffix(",")}, {fx.JOBS_SQL}, videos as (select distinct vec_id // 50 as video_id, 'video' || vec_id // 50 as checksum, 100 as size_bytes from embeddings where label <> 9 union all select max(vec_id // 50), 'x', 1 from embeddings),
files as (select video_id, case when video_id % 4 = 1 then 'changed' else 'video' || video_id end as checksum, case when video_id % 5 = 2 then 99 else 100 end as size_bytes from (select distinct vec_id // 50 as video_id from embeddings) where video_id % 7 <> 3),
shots as (select vec_id // 25 as shot_id, min(vec_id // 50) + case when bool_or(label = 8 and vec_id % 25 = 4) then 1000 else 0 end as video_id, min(vec_id % 50) as a, max(vec_id % 50) - case when bool_or(label = 6 and vec_id % 25 = 7) then 100 else 0 end as b from embeddings group by 1 having min(vec_id // 25) % 9 <> 4),
frames as (select vec_id as frame_id, vec_id // 50 as video_id, case when label = 2 and vec_id % 5 = 0 then vec_id // 25 + 1 else vec_id // 25 end as shot_id from embeddings where label <> 1 union all select vec_id, vec_id // 50, vec_id // 25 from embeddings where label = 0 and vec_id % 3 = 0),
v as (select case when label = 4 and vec_id % 10 < 2 then vec_id + 1000000 else vec_id end as frame_id, case when label = 7 and vec_id % 10 < 2 then 'NaN'::double else 0 end as first from embeddings where label <> 3 or vec_id % 4 <> 0),
docs as (select doc_id, case when doc_id % 2 = 0 then 'ocr' else 'asr' end as source, doc_id % 500 as frame_id, doc_id % 13 as video_id from documents), caps as (select page_id * 7 as frame_id from pages)"""


def _manifests(spark, sf):
    e, i = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_id"), "label", "embedding"), F.col("frame_id")
    e = e.withColumn("video_id", F.expr("frame_id div 50")).withColumn("shot_id", F.expr("frame_id div 25"))
    name = F.concat(F.lit("video"), F.col("video_id").cast("string"))
    videos = e.where("label <> 9").select("video_id").distinct().select("video_id", name.alias("checksum"), F.lit(100).alias("size_bytes"))
    videos = videos.unionByName(e.agg(F.max("video_id").alias("video_id")).select("video_id", F.lit("x").alias("checksum"), F.lit(1).alias("size_bytes")))
    files = e.select("video_id").distinct().where("video_id % 7 <> 3")
    files = files.select("video_id", F.when(F.col("video_id") % 4 == 1, "changed").otherwise(name).alias("checksum"), F.when(F.col("video_id") % 5 == 2, 99).otherwise(100).alias("size_bytes"))
    at, wrong, short = i % 50, F.bool_or((F.col("label") == 8) & (i % 25 == 4)), F.bool_or((F.col("label") == 6) & (i % 25 == 7))
    shots = e.where("shot_id % 9 <> 4").groupBy("shot_id").agg((F.min("video_id") + F.when(wrong, 1000).otherwise(0)).alias("video_id"), F.min(at).alias("start_frame"), (F.max(at) - F.when(short, 100).otherwise(0)).alias("end_frame"))
    moved = F.when((F.col("label") == 2) & (i % 5 == 0), F.col("shot_id") + 1).otherwise(F.col("shot_id"))
    frames = e.where("label <> 1").select("frame_id", "video_id", moved.alias("shot_id")).unionByName(e.where("label = 0 and frame_id % 3 = 0").select("frame_id", "video_id", "shot_id"))
    odd = F.when((F.col("label") == 7) & (i % 10 < 2), F.transform("embedding", lambda v, k: F.when(k == 0, F.lit(float("nan"))).otherwise(v).cast("float"))).otherwise(F.col("embedding"))
    v = e.where("label <> 3 or frame_id % 4 <> 0").select(F.when((F.col("label") == 4) & (i % 10 < 2), i + 1_000_000).otherwise(i).alias("frame_id"), odd.alias("embedding"))
    d = F.col("doc_id")
    docs = fx.table(spark, sf, "documents").select("doc_id", F.when(d % 2 == 0, "ocr").otherwise("asr").alias("source"), (d % 500).alias("frame_id"), (d % 13).alias("video_id"))
    paths, there = _paths(spark, sf)
    return {
        "videos": videos, "files": files, "shots": shots, "frames": frames, "vectors": v, "docs": docs, "captions": fx.table(spark, sf, "pages").select((F.col("page_id") * 7).alias("frame_id")),
        "paths": quality.path_states(paths, there, "/runs/a"), "jobs": store.job_states(fx.jobs(spark, sf)),
    }


ISSUES = f"""{MANIFESTS}, pn as (select frame_id, trim(path) as raw, replace(path, '\\', '/') as path from paths), pr as (select *, regexp_replace(replace(case when starts_with(path, '/') then path else '/runs/a/' || path end, '/./', '/'), '/[^/]+/\\.\\.(/|$)', '/') as resolved from pn),
there as (select '/runs/a/frames/' || page_id as file from pages where length(html) % 4 <> 0), fs as (select distinct f.*, s.video_id as shot_video from frames f left join shots s using (shot_id)), jn as (select *, row_number() over (partition by item_id, stage order by step desc) as n from jobs),
issues as (select 'MISSING_VIDEO_FILE' as code, 'WARNING' as severity, video_id as item from videos where video_id not in (select video_id from files) union all select 'VIDEO_SIZE_MISMATCH', 'ERROR', video_id from videos v join files f using (video_id) where v.size_bytes <> f.size_bytes
union all select 'VIDEO_CHECKSUM_MISMATCH', 'ERROR', video_id from videos v join files f using (video_id) where v.size_bytes = f.size_bytes and v.checksum <> f.checksum union all select 'DUPLICATE_VIDEO', 'ERROR', video_id from videos group by video_id having count(*) > 1
union all select 'UNKNOWN_SHOT_VIDEO', 'ERROR', shot_id from shots where video_id not in (select video_id from videos) union all select 'INVALID_SHOT_BOUNDARY', 'ERROR', shot_id from shots where b < a
union all select 'DUPLICATE_FRAME', 'ERROR', frame_id from frames group by frame_id having count(*) > 1 union all select 'UNKNOWN_FRAME_VIDEO', 'ERROR', frame_id from fs where video_id not in (select video_id from videos)
union all select 'UNKNOWN_FRAME_SHOT', 'ERROR', frame_id from fs where shot_video is null union all select 'FRAME_SHOT_VIDEO_MISMATCH', 'ERROR', frame_id from fs where shot_video <> video_id
union all select case when raw = '' then 'FRAME_PATH_MISSING' when not starts_with(resolved, '/runs/a/') then 'FRAME_PATH_OUTSIDE_EXPERIMENT' when resolved not in (select file from there) then 'FRAME_FILE_MISSING' else 'FRAME_PATH_NOT_CANONICAL' end, 'ERROR', frame_id from pr where raw = '' or not starts_with(resolved, '/runs/a/') or resolved not in (select file from there) or starts_with(path, '/')
union all select 'EMBEDDING_NON_FINITE', 'ERROR', frame_id from v where isnan(first) union all select 'EMBEDDING_UNKNOWN_FRAME', 'ERROR', frame_id from v where frame_id not in (select frame_id from frames) union all select distinct 'EMBEDDING_COVERAGE_INCOMPLETE', 'ERROR', frame_id from frames where frame_id not in (select frame_id from v)
union all select 'OCR_UNKNOWN_FRAME', 'ERROR', doc_id from docs where source = 'ocr' and frame_id not in (select frame_id from frames) union all select 'ASR_UNKNOWN_VIDEO', 'ERROR', doc_id from docs where source = 'asr' and video_id not in (select video_id from videos)
union all select 'CAPTION_UNKNOWN_FRAME', 'ERROR', frame_id from caps where frame_id not in (select frame_id from frames) union all select 'JOB_NOT_COMPLETED', 'ERROR', item_id from jn where n = 1 and status in ('FAILED', 'BLOCKED'))"""


@query(f"{ISSUES} select * from issues")
def G1_integrity(spark, sf):
    return quality.issues(_manifests(spark, sf), 64)


@query(f"{ISSUES} select case when g.code = 'MISSING_VIDEO_FILE' then 'DEGRADED' else 'INVALID' end as status, g.code as gate, count(*) as n_issues from issues g group by all union all select 'READY', 'none', 0")
def G1_readiness(spark, sf):
    """The status that each kind of issue alone would lead to, and that of none."""
    found = quality.issues(_manifests(spark, sf), 64)
    return quality.readiness(found, ["code"]).withColumnRenamed("code", "gate").unionByName(quality.readiness(found.where("false")).select("status", F.lit("none").alias("gate"), "n_issues")).select("status", "gate", "n_issues")


@query(f"""{MANIFESTS} select 64 as dims, count(*) as n, count(distinct frame_id) as n_frames, count(*) filter (isnan(first)) as n_not_finite, count(distinct frame_id) filter (frame_id not in (select frame_id from frames)) as n_unknown,
  (select count(distinct frame_id) from frames where frame_id not in (select frame_id from v)) as n_missing, round(count(distinct frame_id) filter (frame_id in (select frame_id from frames)) / (select count(distinct frame_id) from frames), 6) as coverage,
  case when count(*) = count(distinct frame_id) and count(*) filter (isnan(first)) = 0 and count(distinct frame_id) filter (frame_id not in (select frame_id from frames)) = 0 and not exists (select 1 from frames where frame_id not in (select frame_id from v)) then 'READY' else 'INVALID' end as status from v""")
def G2_embedding_checks(spark, sf):
    m = _manifests(spark, sf)
    return quality.embedding_report(m["vectors"], m["frames"], 64).withColumn("coverage", r6("coverage"))


@query("select 'a' as model, count(*) filter (label = 5) as n_missing from embeddings union all select 'b', count(*) filter (label = 3) from embeddings")
def G3_alignment(spark, sf):
    """The frames of one label are missing from one model, those of another from the other."""
    return quality.alignment(_lacking(spark, sf))


@query("select doc_id, sha256(text) <> sha256(regexp_replace(text, ' +', ' ', 'g')) as stale from documents")
def G4_staleness(spark, sf):
    """Stored digests are those of texts whose runs of spaces had been one: others have changed since."""
    d = fx.table(spark, sf, "documents")
    stored = d.select("doc_id", F.sha2(F.regexp_replace("text", " +", " "), 256).alias("checksum"))
    return quality.staleness(d.select("doc_id", F.sha2("text", 256).alias("checksum")), stored, "doc_id")


@query("""with d as (select doc_id, lang, source, n_chars, nullif(text, '') is null as blank, case when n_chars > 1000 then lang end as large from documents), p as (select a.doc_id, unnest(list_filter([case when a.lang is distinct from b.lang then 'lang' end, case when a.source is distinct from b.source then 'source' end,
case when a.n_chars is distinct from b.n_chars then 'n_chars' end, case when a.blank is distinct from b.blank then 'blank' end, case when a.large is distinct from b.large then 'large' end], lambda f: f is not null)) as field from d a join d b on b.doc_id = a.doc_id + 1) select * from p""")
def G5_provenance(spark, sf):
    """Five fields of each document against those of the one after it; one of them may be null."""
    d = fx.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", F.nullif("text", F.lit("")).isNull().alias("blank"), F.when(F.col("n_chars") > 1000, F.col("lang")).alias("large"))
    return quality.provenance_changes(d, d.withColumn("doc_id", F.col("doc_id") - 1), "doc_id", ["lang", "source", "n_chars", "blank", "large"])


EVAL = f"""{HEAD} {SCORED}, res as (select query_id, rank, frame_id as item from hits where model = 'a'), qr as (select e.vec_id as item, q.vec_id as query_id, e.vec_id // 5 as target from embeddings e join embeddings q on e.label = q.label and q.vec_id % 50 = 0),
j as (select res.*, target, row_number() over (partition by query_id, target order by rank) as n from res left join qr using (query_id, item)), g as (select query_id, rank, item, max(case when target is not null and n = 1 then 1 else 0 end) as gain, sum(case when target is not null and n = 1 then 1 else 0 end) as targets from j group by all),
nn as (select query_id, count(distinct target) as n from qr group by all), a as (select query_id, sum(case when rank <= 10 then targets else 0 end) as f10, sum(case when rank <= 50 then targets else 0 end) as f50, sum(case when rank <= 10 then gain / log2(rank + 1) else 0 end) as dcg, min(case when gain > 0 then rank end) as first from g group by all)"""


def _results(spark, sf):
    res = _hits(spark, sf).where("model = 'a'").select("query_id", "rank", F.col("frame_id").alias("item"))
    e = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("item"), "label")
    q = e.where(F.col("item") % fx.QUERY_STEP == 0).select(F.col("item").alias("query_id"), "label")
    return res, e.join(q, "label").select("query_id", "item", F.expr("item div 5").alias("target"))


@query(f"{EVAL} select query_id, round(f10 / n::double, 6) as recall, round(f50 / n::double, 6) as candidate_recall, round(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 6) as ndcg, round(1.0::double / first, 6) as mrr from a join nn using (query_id)")
def E1_metrics(spark, sf):
    """Recall, candidate recall (E1), nDCG with novelty (E2), MRR (E3)."""
    m = evaluate.metrics(*_results(spark, sf))
    return m.select("query_id", *[r6(c).alias(c) for c in ("recall", "candidate_recall", "ndcg", "mrr")])


@query(f"{EVAL} select query_id, rank, item, gain::bigint as gain from g")
def E2_novelty(spark, sf):
    return evaluate.novelty(*_results(spark, sf)).select("query_id", "rank", "item", F.col("gain").cast("long").alias("gain"))


@query(f"{EVAL} select query_id, round(coalesce(1.0::double / first, 0), 6) as mrr from nn left join a using (query_id)")
def E3_mrr(spark, sf):
    """The reciprocal rank of the first novel hit."""
    return evaluate.metrics(*_results(spark, sf)).select("query_id", r6("mrr").alias("mrr"))


@query(f"{HEAD} {SCORED} select query_id, model, frame_id, rank, round(1 / rank, 9) as reciprocal, round(1 / log2(rank + 1), 9) as discount from hits")
def W16_discounts(spark, sf):
    reciprocal, log = evaluate.discounts()
    return _hits(spark, sf).select("query_id", "model", "frame_id", "rank", F.round(reciprocal, 9).alias("reciprocal"), F.round(log, 9).alias("discount"))


# Moments of a query: in each video the span of the frames of its label; evidence of speech: intervals that hold a result's time.
RELEVANT = f"""{HEAD.replace('with ', 'with ' + INTERVALS[5:] + MAPPED + ', ', 1)} {SCORED}, res as (select query_id, rank, frame_id, f.video_id, f.timestamp_sec as ts from hits join frames f using (frame_id) where model = 'a'),
lb as (select q.vec_id as query_id, e.vec_id as frame_id from embeddings e join embeddings q on e.label = q.label and q.vec_id % 50 = 0), mo as (select query_id, f.video_id, min(timestamp_sec) as c, max(timestamp_sec) as d from lb join frames f using (frame_id) group by all)"""


def _relevant(spark, sf):
    res = _hits(spark, sf).where("model = 'a'").join(fx.frames(spark, sf), "frame_id").select("query_id", "rank", "frame_id", "video_id", F.col("timestamp_sec").alias("ts"))
    e = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_id"), "label")
    q = e.where(F.col("frame_id") % fx.QUERY_STEP == 0).select(F.col("frame_id").alias("query_id"), "label")
    labelled = e.join(q, "label").select("query_id", "frame_id").join(fx.frames(spark, sf), "frame_id")
    moments = labelled.groupBy("query_id", "video_id").agg(F.min("timestamp_sec").alias("start_sec"), F.max("timestamp_sec").alias("end_sec"))
    return res, labelled.select("query_id", "frame_id"), moments


@query(f"""{RELEVANT}, sg as (select w.frame_id, start_sec as a, end_sec as b from w join iv using (doc_id) where weight = 1 and w.frame_id in (select frame_id from frames f where f.timestamp_sec between start_sec and end_sec)),
ca as (select res.*, coalesce(sg.a, ts - 1) as a, coalesce(sg.b, ts + 1) as b from res left join sg using (frame_id)), io as (select query_id, rank, case when greatest(b, d) - least(a, c) > 0 then greatest(0, least(b, d) - greatest(a, c)) / (greatest(b, d) - least(a, c)) else 0 end as iou from ca join mo using (query_id, video_id)),
g as (select query_id, max(iou) as best, max(iou) filter (rank = 1) as top1 from io group by all) select query_id, round(coalesce(best, 0), 6)::double as best, round(coalesce(top1, 0), 6)::double as top1, (coalesce(top1, 0) >= 0.5)::int::double as r1_50, (coalesce(top1, 0) >= 0.7)::int::double as r1_70 from (select distinct query_id from mo) left join g using (query_id)""")
def E4_temporal_iou(spark, sf):
    """Of all results of a query the best, and the first one's: speech intervals around a frame, else a second on either side."""
    res, _, moments = _relevant(spark, sf)
    iv = temporal.infer_intervals(fx.speech(spark, sf))
    seg = temporal.map_intervals(iv, _video_frames(spark, sf)).where("weight = 1").join(iv.select("doc_id", "start_sec", "end_sec"), "doc_id").join(_video_frames(spark, sf).select("frame_id", "ts"), "frame_id")
    seg = seg.where(F.col("ts").between(F.col("start_sec"), F.col("end_sec"))).select("frame_id", F.col("start_sec").alias("seg_start"), F.col("end_sec").alias("seg_end"))
    speech = res.select("query_id", "frame_id").join(seg, "frame_id")
    out = evaluate.temporal_scores(res, moments, speech)
    return out.select("query_id", r6("best").alias("best"), r6("top1").alias("top1"), "r1_50", "r1_70")


@query(f"""{RELEVANT}, cv as (select query_id, video_id, row_number() over (partition by query_id order by min(rank)) as n from res group by query_id, video_id), tv as (select distinct query_id, video_id from mo),
rc as (select query_id, count(*) filter (n <= 3) / count(*) as recall from tv left join cv using (query_id, video_id) group by all), ea as (select query_id, max(case when lb.frame_id is not null then 1 else 0 end)::double as accuracy from (select * from res where rank <= 6) left join lb using (query_id, frame_id) group by all),
fv as (select query_id, video_id from cv where n = 1), pv as (select query_id, video_id, min(ts) as a, max(ts) as b from res join fv using (query_id, video_id) where rank <= 6 group by all), px as (select query_id, video_id, case when b > a then a else greatest(0, a - 0.5) end as a, case when b > a then b else a + 0.5 end as b from pv),
io as (select query_id, max(greatest(0, least(b, d) - greatest(a, c)) / (greatest(b, d) - least(a, c))) as iou from px join mo using (query_id, video_id) group by all)
select query_id, round(recall, 6) as video_recall, accuracy, round(coalesce(iou, 0), 6)::double as iou from rc join ea using (query_id) left join io using (query_id)""")
def E7_grounding(spark, sf):
    """Video recall of the first three, evidence accuracy of the first six frames, and the IoU of the first video's span."""
    res, relevant, moments = _relevant(spark, sf)
    cands = res.groupBy("query_id", "video_id").agg(F.min("rank").alias("first")).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("first")))
    six = res.where("rank <= 6")
    recall = evaluate.video_recall(moments.select("query_id", "video_id"), cands)
    accuracy = evaluate.evidence_accuracy(relevant, moments, six)
    spans = six.join(cands.where("rank = 1").select("query_id", "video_id"), ["query_id", "video_id"], "left_semi").groupBy("query_id", "video_id").agg(F.array_sort(F.collect_list("ts")).alias("times"))
    spans = spans.withColumn("s", evaluate.span_of(F.col("times")[0], F.col("times")[0], F.col("times"))).join(moments, ["query_id", "video_id"])
    iou = spans.groupBy("query_id").agg(F.max(temporal.iou(F.col("s.a"), F.col("s.b"), F.col("start_sec"), F.col("end_sec"))).alias("iou"))
    out = recall.join(accuracy, "query_id").join(iou, "query_id", "left")
    return out.select("query_id", r6("recall").alias("video_recall"), "accuracy", r6(F.coalesce("iou", F.lit(0.0))).alias("iou"))


@query("with s as (select user_id as query_id, list(distinct event_type) filter (event_id % 2 = 0) as p, list(distinct event_type) filter (event_id % 3 = 0) as e from events group by all) select query_id, round(case when p is null then (case when e is null then 1 else 0 end) else len(list_intersect(p, coalesce(e, []))) / len(p)::double end, 6) as precision, round(case when e is null then 1 else len(list_intersect(coalesce(p, []), e)) / len(e)::double end, 6) as recall from s")
def E5_routes(spark, sf):
    e = fx.table(spark, sf, "events")
    g = e.groupBy(F.col("user_id").alias("query_id")).agg(F.collect_set(F.when(F.col("event_id") % 2 == 0, F.col("event_type"))).alias("predicted"), F.collect_set(F.when(F.col("event_id") % 3 == 0, F.col("event_type"))).alias("expected"))
    return evaluate.route_scores(g).select("query_id", r6("precision").alias("precision"), r6("recall").alias("recall"))


@query("""select * from (values ('kis', true, false, false, null, null, null, null, null, null), ('kis_ocr', true, true, false, null, null, null, null, null, null), ('kis_asr', true, false, true, null, null, null, null, null, null), ('all_fixed', null, null, null, 'fixed', null, null, null, null, null),
('all_adaptive', null, null, null, 'adaptive', null, null, null, null, null), ('all_no_llm', null, null, null, 'adaptive', false, null, null, null, null), ('asr_nearest', null, false, null, null, null, false, null, null, null), ('all_no_rerank', null, null, null, 'adaptive', null, null, false, false, null),
('joint_text', null, null, null, 'adaptive', null, null, null, null, 'joint')) t(preset, enable_kis, enable_ocr, enable_asr, fusion_mode, use_llm, temporal_asr, use_reranker, use_evidence_reranker, text_search_mode)""")
def E6_ablations(spark, sf):
    """Presets of switches; null: as the search has it."""
    flags = ("enable_kis", "enable_ocr", "enable_asr", "fusion_mode", "use_llm", "temporal_asr", "use_reranker", "use_evidence_reranker", "text_search_mode")
    rows = [(name, *(chosen.get(f) for f in flags)) for name, chosen in evaluate.ABLATIONS.items()]
    return spark.createDataFrame(rows, "preset string, " + ", ".join(f"{f} {'string' if f.endswith('mode') else 'boolean'}" for f in flags))


NORMAL = "trim(regexp_replace(regexp_replace({c}, '^(?:x|đáp án|câu trả lời)\\s+(?:là)\\s+', ''), '^(?:the answer|answer|x)\\s+(?:is)\\s+', ''))"
ANSWER = NORMAL.format(c=SQZ.format(c="regexp_replace(" + CASED.format(c="text") + ", '[\\p{P}\\p{S}]', ' ', 'g')"))


@query(f"""with a as (select conv_id, turn, {ANSWER} as t from conversations), p as (select a.conv_id, a.turn, a.t as p, list_filter(list_filter([b.t, c.t], lambda r: r is not null), lambda r: r <> '') as refs from a left join a b on a.conv_id = b.conv_id and b.turn = a.turn + 1 left join a c on a.conv_id = c.conv_id and c.turn = a.turn + 2),
u as (select conv_id, turn, p, unnest(refs) as r from p), w as (select *, list_filter(string_split(p, ' '), lambda w: w <> '') as a, string_split(r, ' ') as b from u),
s as (select *, list_sum(list_transform(list_distinct(a), lambda w: least(len(list_filter(a, lambda v: v = w)), len(list_filter(b, lambda v: v = w))))) as shared from w),
g as (select conv_id, turn, max(case when p = r then 1 else 0 end)::double as em, max(case when shared > 0 then 2 * shared / (len(a) + len(b)) else 0 end)::double as f1 from s group by all)
select conv_id * 1000 + turn as pair_id, em, round(f1, 6) as f1 from p left join g using (conv_id, turn)""")
def E7_answers(spark, sf):
    """A turn against the two after it as references, as plain answers; null at the end of a conversation."""
    c = fx.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    nxt = lambda k: c.select("conv_id", (F.col("turn") - k).alias("turn"), F.col("text").alias(f"r{k}"))
    j = c.join(nxt(1), ["conv_id", "turn"], "left").join(nxt(2), ["conv_id", "turn"], "left")
    pairs = j.select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), F.col("text").alias("answer"), F.array_compact(F.array("r1", "r2")).alias("references"))
    return evaluate.answer_scores(pairs).withColumn("f1", r6("f1"))


# Runs of a query (a user): its events by the JSON's k in thirds; the strongest event is the answer, its day the video, the kinds of events the evidence.
RUNS = f"""e as (select user_id as query_id, {fx.K_SQL} % 3 as run, event_type, value, event_id from events), r as (select query_id, run, case when max(value) > 30 then 'answered' else 'unsure' end as status, arg_max(event_type, value) as answer, (arg_max(event_id, value) // 1000)::varchar as video, list(distinct event_type) filter (value > 20) as ev from e group by all)"""


@query(f"""with {RUNS}, n as (select query_id from r group by query_id having count(*) >= 2), p as (select a.query_id, len(list_intersect(coalesce(a.ev, []), coalesce(b.ev, []))) / len(list_distinct(list_concat(coalesce(a.ev, []), coalesce(b.ev, [])))) as j from r a join r b on a.query_id = b.query_id and a.run < b.run where len(coalesce(a.ev, [])) + len(coalesce(b.ev, [])) > 0),
j as (select query_id, avg(j) as evidence from p group by all), s as (select query_id, (count(distinct status || '|' || answer) = 1)::int::double as answers, (count(distinct status || '|' || video) = 1)::int::double as videos from r group by all)
select query_id, answers, videos, round(evidence, 6) as evidence, (answers + videos) / 2 as overall from s join n using (query_id) left join j using (query_id)""")
def E8_stability(spark, sf):
    e = fx.table(spark, sf, "events").withColumn("run", fx.k_of("props") % 3)
    best = F.max_by(F.struct("event_type", "event_id"), "value")
    runs = e.groupBy(F.col("user_id").alias("query_id"), "run").agg(F.when(F.max("value") > 30, "answered").otherwise("unsure").alias("status"), best.alias("b"), F.collect_set(F.when(F.col("value") > 20, F.col("event_type"))).alias("evidence"))
    runs = runs.select("query_id", "run", "status", F.col("b.event_type").alias("answer"), F.expr("cast(b.event_id div 1000 as string)").alias("video"), "evidence")
    return evaluate.stability(runs).withColumn("evidence", r6("evidence"))
