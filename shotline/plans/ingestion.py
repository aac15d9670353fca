"""Sources, sinks and manifests as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotline.operators import quality
from shotline.plans.registry import query
from shotline.plans.scalars import PATHS, _paths
from shotline.sources import fixtures as fx
from shotline.sources import store

r6 = lambda c: F.round(c, 6)


FILES = "'/root/testdata/sf0.01/**'"


@query(f"select regexp_extract(filename, '([^/]+)$', 1) as name, size as size_bytes, row_number() over (order by filename) as place from read_blob({FILES}) where filename ilike '%.parquet'")
def S1_discover(spark, sf):
    w = Window.orderBy("path")  # one row for each file
    return store.discover(spark, sf, ("PARQUET",)).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "size_bytes", F.row_number().over(w).alias("place"))


@query(f"select sha256(content)[1:16] as video_id, sha256(content) as checksum from read_blob({FILES})")
def S2_fingerprints(spark, sf):
    return store.fingerprints(spark, sf).select("video_id", "checksum")


@query("select event_id, props->>'$.page' as page, props->>'$.k' as k from events where event_id % 10 <> 0")
def S3_permissive_json(spark, sf):
    """Corrupt records (every tenth is cut) are dropped."""
    schema = T.StructType([T.StructField("page", T.StringType()), T.StructField("k", T.StringType())])
    e = fx.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, F.substring("props", 1, 3)).otherwise(F.col("props")).alias("line"))
    p = e.select("event_id", F.from_json("line", T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return p.where("r is not null and r._bad is null").select("event_id", "r.page", "r.k")


ROW = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("value", T.DoubleType())])


def _lines(spark, sf):
    e = fx.table(spark, sf, "events").select("event_id", F.col("event_type").alias("kind"), "value")
    return e, F.to_json(F.struct(*sorted(e.columns)))


@query("select event_id, event_type as kind, value from events")
def S4_strict_json(spark, sf):
    """A manifest of sound lines; a corrupt one would fail the read (tested)."""
    e, line = _lines(spark, sf)
    path = store.workspace(spark, "strict")
    e.select(line.alias("value")).write.text(path)
    return store.read_jsonl(spark, path, ROW, strict=True)[0]


@query("select event_id, event_type as kind, value from events where event_id % 10 <> 0")
def K10_repair(spark, sf):
    """Every tenth line is cut; the manifest is rewritten with the sound ones, the old kept beside."""
    e, line = _lines(spark, sf)
    path = store.workspace(spark, "repair")
    e.select(F.when(F.col("event_id") % 10 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(path)
    store.repair(spark, path, ROW, dry_run=True)  # changes nothing
    store.repair(spark, path, ROW, dry_run=False)
    return store.read_jsonl(spark, path, ROW, strict=True)[0]


@query("""select event_id, '{"event_id":' || event_id || ',"kind":"' || event_type || '","note":"đã ' || user_id || '"}' as line from events""")
def K1_append(spark, sf):
    """Two appends of records with sorted keys, accents as they are."""
    e = fx.table(spark, sf, "events").select("event_id", F.col("event_type").alias("kind"), F.concat(F.lit("đã "), "user_id").alias("note"))
    path = store.workspace(spark, "append")
    store.append_jsonl(e.where("event_id % 2 = 0"), path)
    store.append_jsonl(e.where("event_id % 2 = 1"), path)
    return spark.read.text(path).select(F.get_json_object("value", "$.event_id").cast("long").alias("event_id"), F.col("value").alias("line"))


@query("select doc_id, lang, 2 as version from documents")
def K2_replace(spark, sf):
    """Written twice: the second stands, the first is kept as .bak (tested)."""
    d = fx.table(spark, sf, "documents").select("doc_id", "lang")
    path = store.workspace(spark, "replace")
    store.replace(d.withColumn("version", F.lit(1)), path, "doc_id")
    store.replace(d.withColumn("version", F.lit(2)), path, "doc_id")
    return spark.read.parquet(path)


@query("select doc_id, n_chars, lang as part, case when lang = 'fr' then 2 else 1 end as version from documents")
def K3_partitions(spark, sf):
    """A partition for each language, one of them written again; all of them as one table."""
    d = fx.table(spark, sf, "documents").select("doc_id", "n_chars", F.col("lang").alias("part"))
    path = store.workspace(spark, "partitions")
    store.write_partitions(d.withColumn("version", F.lit(1)), path, ["part"])
    store.write_partitions(d.where("part = 'fr'").withColumn("version", F.lit(2)), path, ["part"])
    return store.consolidate(spark, path, "doc_id").select("doc_id", "n_chars", "part", "version")


@query(f"with {fx.DOCS_SQL} select source, count(*) as n, count(distinct doc_id) as n_ids, sum(length(text))::bigint as n_chars from text_docs group by all")
def K6_text_store(spark, sf):
    path = store.workspace(spark, "text")
    store.build_text_store(fx.text_docs(spark, sf), path)
    return spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_ids"), F.sum(F.length("text")).alias("n_chars"))


@query(f"with {fx.VECTORS_SQL} select model, frame_id, round(e[1], 6) as first, len(e) as dims from vectors")
def K7_vector_store(spark, sf):
    """The store, written by model and in ranges of ids, and read back."""
    path = store.workspace(spark, "vectors")
    store.build_vector_store(fx.vectors(spark, sf), path, 4)
    return spark.read.parquet(path).select("model", "frame_id", r6(F.col("embedding")[0].cast("double")).alias("first"), F.size("embedding").cast("long").alias("dims"))


CONFIG = {"embedding_models": ["a", "b"], "frame_sampling": "shot-percentile", "pipeline": "retrieval"}
CANONICAL = '{"embedding_models":["a","b"],"frame_sampling":"shot-percentile","pipeline":"retrieval"}'


@query(f"select sha256('{CANONICAL}')[1:8] as config_hash, (select count(*) from documents) as documents, 'READY' as status")
def K9_artifacts(spark, sf):
    """A readiness report as one JSON file, read back."""
    path = store.workspace(spark, "artifact")
    n = fx.table(spark, sf, "documents").count()
    store.write_json(spark, {"status": "READY", "documents": n, "config_hash": store.config_hash(CONFIG)}, path)
    value = spark.read.text(path).select(F.from_json("value", "config_hash string, documents long, status string").alias("v"))
    return value.select("v.*")


@query(f"""select plan, plan in ('current') as runs from (values ('current'), ('pending'), ('other_config'), ('other_data')) t(plan)""")
def G6_plan_check(spark, sf):
    """A plan runs if it was approved for this configuration and these data."""
    data = store.profile(store.entries(spark, sf, ("parquet",))).first().fingerprint
    current = {"status": "APPROVED", "config_hash": store.config_hash(CONFIG), "dataset": data}
    plans = {"current": current, "pending": current | {"status": "PENDING_APPROVAL"}, "other_config": current | {"config_hash": store.config_hash(CONFIG | {"pipeline": "x"})}, "other_data": current | {"dataset": "0" * 64}}
    return spark.createDataFrame([(n, store.plan_is_current(p, CONFIG, data)) for n, p in plans.items()], "plan string, runs boolean")


MIGRATION = f"with {PATHS}, n as (select frame_id, path as was, trim(path) as raw, replace(path, '\\\\', '/') as path from paths), r as (select *, regexp_replace(replace(case when starts_with(path, '/') then path else '/runs/a/' || path end, '/./', '/'), '/[^/]+/\\\\.\\\\.(/|$)', '/') as resolved from n), s as (select *, case when raw <> '' and starts_with(resolved, '/runs/a/') and resolved in (select file from files) then resolved[9:] end as new_path from r)".replace("\\\\", "\\")


@query(f"{MIGRATION} select frame_id, coalesce(new_path, '') as new_path, new_path is not null and new_path <> path as changed, new_path is null as issue, (select count(*) from s where new_path is null) = 0 as may_apply from s")
def G7_path_migration(spark, sf):
    """Paths as relative ones; a plan with an unresolved record must not be applied."""
    paths, files = _paths(spark, sf)
    plan = quality.path_migration(quality.path_states(paths, files, "/runs/a"), "/runs/a")
    return plan.select("frame_id", F.coalesce("new_path", F.lit("")).alias("new_path"), "changed", "issue", "may_apply")


@query("select top_k, least(100, greatest(1, top_k)) as held from (values (-5), (0), (1), (50), (100), (1000)) t(top_k)")
def L6_clamp(spark, sf):
    from shotline.operators import ranking

    return spark.createDataFrame([(k, ranking.clamp_k(k)) for k in (-5, 0, 1, 50, 100, 1000)], "top_k int, held int")


@query("select distinct source from documents")
def S5_distinct_keys(spark, sf):
    return fx.table(spark, sf, "documents").select("source").distinct()


@query("select 'a' as model, count(*) as n, sum(vec_id)::bigint as ids from embeddings where label <> 3 union all select 'b', count(*), sum(vec_id)::bigint from embeddings where label > 5")
def S7_finished_or_checkpoint(spark, sf):
    """One model has finished vectors, whatever its unfinished run holds; the other only has those of its run."""
    label = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_id"), "label")
    v = fx.vectors(spark, sf).join(label, "frame_id")
    out = store.finished_or_checkpoint(v.where("model = 'a' and label <> 3"), v.where("label > 5"))
    return out.groupBy("model").agg(F.count("*").alias("n"), F.sum("frame_id").alias("ids"))


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by event_id desc) as n from events) where n = 1")
def S8_last_row_wins(spark, sf):
    return store.keep_latest(fx.table(spark, sf, "events"), "user_id", ["event_id"]).select("user_id", "event_id", "event_type")


@query("select doc_id, lang, source, n_chars from documents")
def S9_dump(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")


QRELS = """q as (select user_id as query_id, list(event_id order by event_id) filter (event_type = 'purchase') as frames, list(struct_pack(a := epoch_us(ts) / 1e6, b := epoch_us(ts) / 1e6 + value)) filter (event_type = 'error') as moments from events group by all)"""


@query(f"with {QRELS} select query_id, len(coalesce(frames, [])) as n_frames, len(coalesce(moments, [])) as n_moments from q where len(coalesce(frames, [])) + len(coalesce(moments, [])) > 0")
def S11_qrels(spark, sf):
    """Queries with relevant frames or moments; repeated ids, none of either or an inverted moment fail the read (tested)."""
    e = fx.table(spark, sf, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    moment = F.struct(F.col("user_id").cast("string").alias("video_id"), F.col("at").alias("start_sec"), (F.col("at") + F.col("value")).alias("end_sec"))
    q = e.groupBy(F.col("user_id").alias("query_id")).agg(F.collect_list(F.when(F.col("event_type") == "purchase", F.col("event_id"))).alias("relevant_frame_ids"), F.collect_list(F.when(F.col("event_type") == "error", moment)).alias("relevant_moments"))
    q = store.checked_qrels(q.withColumn("query", F.concat(F.lit("query "), "query_id")).where("size(relevant_frame_ids) + size(relevant_moments) > 0"))
    return q.select("query_id", F.size("relevant_frame_ids").cast("long").alias("n_frames"), F.size("relevant_moments").cast("long").alias("n_moments"))


@query("""with n as (select 'v' || vec_id // 50 || case label when 1 then '_f' || lpad((vec_id % 50)::varchar, 4, '0') when 2 then '-' || vec_id || '.jpg' when 3 then '_s' || vec_id // 25 || '_x' || vec_id else '_s' || vec_id // 25 || '_f' || lpad(vec_id::varchar, 8, '0') end as frame_id from embeddings), p as (select *, string_split(frame_id, '_') as p from n)
select frame_id, p[1] as video_id, case when len(p) > 2 then p[2] else p[1] || '_s0' end as shot_id, case when regexp_matches(frame_id, '_f[0-9]+') then regexp_extract(frame_id, '_f([0-9]+)', 1)::bigint else 0 end as frame_index,
  null::double as timestamp_sec, 'frames/' || p[1] || '/' || frame_id || case when ends_with(frame_id, '.jpg') then '' else '.jpg' end as frame_path from p""")
def S13_parse_ids(spark, sf):
    """Names of four forms, by label: with a shot, without one, without an index, and of a file."""
    v, shot, label = F.col("vec_id"), F.expr("vec_id div 25").cast("string"), F.col("label")
    tail = (
        F.when(label == 1, F.concat(F.lit("_f"), F.lpad((v % 50).cast("string"), 4, "0"))).when(label == 2, F.concat(F.lit("-"), v, F.lit(".jpg"))).when(label == 3, F.concat(F.lit("_s"), shot, F.lit("_x"), v))
        .otherwise(F.concat(F.lit("_s"), shot, F.lit("_f"), F.lpad(v.cast("string"), 8, "0")))
    )
    return store.frames_from_names(fx.table(spark, sf, "embeddings").select(F.concat(F.lit("v"), F.expr("vec_id div 50"), tail).alias("frame_id")))


@query("select doc_id, case when doc_id % 3 = 0 then 2 else 1 end as version from documents union all select doc_id + 1000000, 2 from documents where doc_id % 6 = 0")
def K4_upsert(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id")
    old = d.withColumn("version", F.lit(1).cast("long"))
    new = d.where("doc_id % 3 = 0").withColumn("version", F.lit(2).cast("long"))
    more = d.where("doc_id % 6 = 0").select((F.col("doc_id") + 1_000_000).alias("doc_id"), F.lit(2).cast("long").alias("version"))
    return store.upsert(old, new.unionByName(new.withColumn("version", F.lit(1).cast("long"))).unionByName(more), "doc_id")


@query("select doc_id from documents where doc_id % 3 <> 0")
def K5_backfill(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id")
    return store.backfill(d, d.where("doc_id % 3 = 0"), "doc_id")


@query(f"with {fx.DOCS_SQL} select doc_id, source from text_docs where doc_id % 2 = 0 union all select doc_id, source from text_docs where doc_id % 2 = 1 and trim(text) <> ''")
def K8_import_text(spark, sf):
    d = fx.text_docs(spark, sf).withColumn("version", F.lit(1))
    return store.import_text(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1")).select("doc_id", "source")


@query("select event_type, epoch_us(time_bucket(interval 1 day, ts)) // 1000000 as day, count(*) as n, round(sum(value), 4) as total from events group by all")
def events_per_day(spark, sf):
    """An extension: windowed counts, as the streaming module has them."""
    e = fx.table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    g = e.groupBy("event_type", F.window("at", "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select("event_type", F.unix_timestamp("w.start").alias("day"), "n", "total")


@query("select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all")
def pricing_summary(spark, sf):
    """A generic aggregate, to watch scans and partial aggregation."""
    li = fx.table(spark, sf, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))
