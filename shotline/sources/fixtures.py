"""The retrieval domain, derived from the driver's tables: the same in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIDEO_FRAMES, SHOT_FRAMES, QUERY_STEP = 50, 25, 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, video_id, shot_id, frame_index, timestamp_sec."""
    v = F.col("vec_id")
    at = F.pmod(v, F.lit(VIDEO_FRAMES))
    return table(spark, sf_dir, "embeddings").select(
        v.alias("frame_id"), F.expr(f"vec_id div {VIDEO_FRAMES}").alias("video_id"), F.expr(f"vec_id div {SHOT_FRAMES}").alias("shot_id"),
        (at * 25).alias("frame_index"), (at * 2).cast("double").alias("timestamp_sec"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, frame_id, embedding: model a as stored, model b reversed."""
    e = table(spark, sf_dir, "embeddings")
    a = e.select(F.lit("a").alias("model"), F.col("vec_id").alias("frame_id"), "embedding")
    return a.unionByName(e.select(F.lit("b").alias("model"), F.col("vec_id").alias("frame_id"), F.reverse("embedding").alias("embedding")))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, model, q: every row whose id is divisible by QUERY_STEP."""
    v = vectors(spark, sf_dir).where(F.col("frame_id") % QUERY_STEP == 0)
    return v.select(F.col("frame_id").alias("query_id"), "model", F.col("embedding").alias("q"))


def text_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source (ocr, asr), frame_id, text."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, "ocr").otherwise("asr").alias("source"), F.pmod("doc_id", F.lit(500)).alias("frame_id"), "text"
    )


def speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, video_id, start_sec, text: conversation turns seven seconds apart."""
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.col("conv_id").alias("video_id"), (F.col("turn") * 7).cast("double").alias("start_sec"), "text"
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, video_id (user), kind, ts (seconds), score: timed points."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.col("user_id").alias("video_id"), F.col("event_type").alias("kind"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.col("value").alias("score"),
    )


def sparse_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, video_id, shot_id, ts: frames of which some labels lack a time, others a shot."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), "label")
    f = frames(spark, sf_dir).join(e, "frame_id")
    return f.select("frame_id", "video_id", F.when(F.col("label") % 4 != 0, F.col("shot_id")).alias("shot_id"), F.when(F.col("label") % 3 != 0, F.col("timestamp_sec")).alias("ts"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, stage, status, updated_at, step, error: a history of jobs, one row for each event."""
    status = F.create_map(*[F.lit(v) for pair in STATUS.items() for v in pair])
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("item_id"), F.when(k_of("props") < 50, "EMBED").otherwise("TEXT").alias("stage"), status[F.col("event_type")].alias("status"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("updated_at"), F.col("event_id").alias("step"), F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
    )


STATUS = {"view": "RUNNING", "click": "BLOCKED", "purchase": "COMPLETED", "signup": "COMPLETED_NO_OUTPUT", "error": "FAILED"}


def k_of(c: str):
    """The number `k` of a JSON text, 0 without one."""
    return F.coalesce(F.get_json_object(c, "$.k").cast("int"), F.lit(0))


def event_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request, event_index, rank, frame_id, video_id, shot_id, ts, consensus, best: ranked hits of three events for each of two requests."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select(
        "event_type", F.col("event_id").alias("frame_id"), F.col("user_id").alias("video_id"), F.when(k_of("props") >= 10, F.expr("event_id div 500")).alias("shot_id"),
        F.when(k_of("props") != 7, F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), (k_of("props") / 100).alias("consensus"), F.least(F.lit(1.0), F.col("value") / 100).alias("best"), "value",
    )
    plan = spark.createDataFrame([(r, i, k) for r, kinds in REQUESTS.items() for i, k in enumerate(kinds)], "request string, event_index int, event_type string")
    rank = F.row_number().over(Window.partitionBy("request", "event_index").orderBy(F.desc("value"), "frame_id"))
    return e.join(F.broadcast(plan), "event_type").withColumn("rank", rank).drop("event_type", "value")


#: Kinds of events that requests look for: their order, of which the last is context.
REQUESTS = {"buy": ("view", "click", "purchase"), "fail": ("click", "error", "signup")}


def whole_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request, rank, frame_id, video_id, ts: what the whole request finds, its first kind of event by another key."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("request").orderBy(F.desc("best"), F.desc("consensus"), "frame_id"))
    return event_results(spark, sf_dir).where("event_index = 0").select("request", rank.alias("rank"), "frame_id", "video_id", "ts")


#: The same as DuckDB common table expressions.
FRAMES_SQL = f"""frames as (select vec_id as frame_id, vec_id // {VIDEO_FRAMES} as video_id, vec_id // {SHOT_FRAMES} as shot_id,
  (vec_id % {VIDEO_FRAMES}) * 25 as frame_index, cast((vec_id % {VIDEO_FRAMES}) * 2 as double) as timestamp_sec, embedding from embeddings)"""
VECTORS_SQL = """vectors as (select 'a' as model, vec_id as frame_id, embedding::double[] as e from embeddings
  union all select 'b', vec_id, list_reverse(embedding)::double[] from embeddings)"""
QUERIES_SQL = f"queries as (select frame_id as query_id, model, e as q from vectors where frame_id % {QUERY_STEP} = 0)"
DOCS_SQL = "text_docs as (select doc_id, case when doc_id % 2 = 0 then 'ocr' else 'asr' end as source, doc_id % 500 as frame_id, text from documents)"
SPEECH_SQL = "speech as (select conv_id * 1000 + turn as doc_id, conv_id as video_id, cast(turn * 7 as double) as start_sec, text from conversations)"
POINTS_SQL = "points as (select event_id, user_id as video_id, event_type as kind, epoch_us(ts) / 1e6 as ts, value as score from events)"
K_SQL = "coalesce(try_cast(props->>'$.k' as int), 0)"
SPARSE_SQL = f"""sparse as (select vec_id as frame_id, vec_id // {VIDEO_FRAMES} as video_id, case when label % 4 <> 0 then vec_id // {SHOT_FRAMES} end as shot_id,
  case when label % 3 <> 0 then cast((vec_id % {VIDEO_FRAMES}) * 2 as double) end as ts from embeddings)"""
JOBS_SQL = f"""jobs as (select user_id as item_id, case when {K_SQL} < 50 then 'EMBED' else 'TEXT' end as stage,
  case event_type when 'view' then 'RUNNING' when 'click' then 'BLOCKED' when 'purchase' then 'COMPLETED' when 'signup' then 'COMPLETED_NO_OUTPUT' when 'error' then 'FAILED' end as status,
  epoch_us(ts) as updated_at, event_id as step, case when event_type = 'error' then props end as error from events)"""
RESULTS_SQL = f"""results as (select request, event_index, row_number() over (partition by request, event_index order by value desc, event_id) as rank, event_id as frame_id, user_id as video_id,
  case when {K_SQL} >= 10 then event_id // 500 end as shot_id, case when {K_SQL} <> 7 then epoch_us(ts) / 1e6 end as ts, {K_SQL} / 100 as consensus, least(1.0::double, value / 100) as best
  from events join (values ('buy', 0, 'view'), ('buy', 1, 'click'), ('buy', 2, 'purchase'), ('fail', 0, 'click'), ('fail', 1, 'error'), ('fail', 2, 'signup')) p(request, event_index, kind) on event_type = kind),
whole as (select request, row_number() over (partition by request order by best desc, consensus desc, frame_id) as rank, frame_id, video_id, ts from results where event_index = 0)"""
