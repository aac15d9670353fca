"""Sources and sinks: JSONL manifests, keyed upserts, partitions, search stores."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def discover(spark: SparkSession, folder: str, extensions: tuple[str, ...]) -> DataFrame:
    """Files below a folder by extension: path, size, in path order; contents aren't read."""
    pattern = r"(?i)\.(" + "|".join(e.lstrip(".") for e in extensions) + ")$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.where(F.col("path").rlike(pattern)).select("path", F.col("length").alias("size_bytes")).orderBy("path")


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """path, checksum (sha256), video_id (its first 16 digits)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.sha2("content", 256).alias("checksum")).withColumn("video_id", F.substring("checksum", 1, 16))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, corrupt): blank lines are skipped; corrupt lines come with a sample of 500 characters, or fail if strict."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = lines.select("value", F.from_json("value", T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    if strict:
        parsed = parsed.withColumn("r", F.when(bad, F.raise_error(F.concat(F.lit("corrupt line: "), F.substring("value", 1, 500)))).otherwise(F.col("r")))
        return parsed.select(*[F.col(f"r.{f.name}") for f in schema]), parsed.where(F.lit(False)).select(F.col("value").alias("sample"))
    return parsed.where(~bad).select(*[F.col(f"r.{f.name}") for f in schema]), parsed.where(bad).select(F.substring("value", 1, 500).alias("sample"))


def workspace(spark: SparkSession, kind: str) -> str:
    """A path of its own in the folder that the cluster shares (spark.checkpoint.dir); a local one only where the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        found = f"file://{tempfile.gettempdir()}/work"
    return f"{found.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Records as JSON with sorted keys."""
    rows.select(*sorted(rows.columns)).write.mode("append").json(path)


def repair(spark: SparkSession, path: str, schema: T.StructType, dry_run: bool = True) -> int:
    """Rewrite a JSONL manifest with its sound lines, the old kept as .bak; returns the corrupt ones. A dry run only counts."""
    rows, corrupt = read_jsonl(spark, path, schema)
    n = corrupt.count()
    if n and not dry_run:
        beside = f"{path}.new-{uuid.uuid4().hex}"
        rows.write.json(beside)
        _rename(spark, beside, path)
    return n


def checked_qrels(qrels: DataFrame) -> DataFrame:
    """(query_id, query, relevant_frame_ids, relevant_moments: (.., start_sec, end_sec)) rows; a faulty one fails when it is read.

    Ids and queries must not be blank, ids not repeat, a row has a frame or a moment,
    and no moment ends before it starts.
    """
    q = qrels.withColumn("_n", F.count("*").over(Window.partitionBy("query_id")))
    fault = (
        F.when(F.coalesce(F.trim(F.col("query_id").cast("string")), F.lit("")) == "", "no query_id").when(F.coalesce(F.trim("query"), F.lit("")) == "", "no query").when(F.col("_n") > 1, "repeated query_id")
        .when(F.exists("relevant_moments", lambda m: m["end_sec"] < m["start_sec"]), "inverted interval").when(F.size("relevant_frame_ids") + F.size("relevant_moments") == 0, "no relevance labels")
    )
    checked = F.when(fault.isNotNull(), F.raise_error(F.concat(fault, F.lit(": "), F.col("query_id").cast("string")))).otherwise(F.col("query_id"))
    return q.withColumn("query_id", checked).drop("_n")


def entries(spark: SparkSession, folder: str, extensions: tuple[str, ...]) -> DataFrame:
    """(path: below the folder, size_bytes, modified_ms) of its files by extension; contents aren't read."""
    pattern = r"(?i)\.(" + "|".join(e.lstrip(".") for e in extensions) + ")$"
    root = folder.rstrip("/").removeprefix("file:")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(F.col("path").rlike(pattern))
    below = F.expr(f"substring(path, locate('{root}/', path) + {len(root) + 1})")
    return files.select(below.alias("path"), F.col("length").alias("size_bytes"), F.unix_millis("modificationTime").alias("modified_ms"))


def profile(files: DataFrame) -> DataFrame:
    """One row: n, bytes, extensions (a map to counts), fingerprint (sha256 of the JSON of all entries in path order). Files are few against rows."""
    rows = F.array_sort(F.collect_list(F.struct("path", "size_bytes", "modified_ms")))
    text = F.array_join(F.transform("rows", lambda r: F.concat(F.lit('["'), r["path"], F.lit('",'), r["size_bytes"].cast("string"), F.lit(","), r["modified_ms"].cast("string"), F.lit("]"))), ",")
    kind = lambda r: F.lower(F.regexp_extract(r["path"], r"(\.[^.]+)$", 1))
    g = files.agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"), rows.alias("rows"))
    kinds = F.transform("rows", kind)
    counts = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(kinds)), lambda k: F.struct(k, F.size(F.filter(kinds, lambda x: x == k)).cast("long"))))
    return g.select("n", "bytes", counts.alias("extensions"), F.sha2(F.concat(F.lit("["), text, F.lit("]")), 256).alias("fingerprint"))


def _rename(spark: SparkSession, source: str, target: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    fs = a.getFileSystem(conf)
    if fs.exists(b):
        backup = jvm.org.apache.hadoop.fs.Path(f"{target}.bak")
        fs.delete(backup, True)
        if not fs.rename(b, backup):
            raise OSError(f"can't keep {target}")
    if not fs.rename(a, b):
        raise OSError(f"can't put {target} in place")


def replace(rows: DataFrame, path: str, key: str) -> int:
    """Write beside, check unique keys and the count read back, keep the old as .bak, rename; returns the rows."""
    spark = rows.sparkSession
    beside = f"{path}.new-{uuid.uuid4().hex}"
    rows.write.parquet(beside)
    back = spark.read.parquet(beside)
    n, distinct = back.agg(F.count("*"), F.countDistinct(key)).first()
    if n != distinct:
        raise ValueError(f"{n - distinct} rows repeat {key}")
    _rename(spark, beside, path)
    return n


def keep_latest(rows: DataFrame, key: str, version: list) -> DataFrame:
    """One row for each key: the last by `version`."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(v) for v in version]))).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `new` replace those of `old` with the same key; of repeats in `new` the last by `version` stays."""
    fresh = keep_latest(new, key, ["version"])
    return old.join(fresh, key, "left_anti").unionByName(fresh)


def backfill(manifest: DataFrame, partitions: DataFrame, key: str) -> DataFrame:
    """Rows of the manifest that no partition has."""
    return manifest.join(partitions, key, "left_anti")


def write_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Replace only the partitions that `rows` touches."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def consolidate(spark: SparkSession, path: str, key: str) -> DataFrame:
    """All partitions as one table; repeated keys are an error when read."""
    rows = spark.read.parquet(path)
    n = F.count("*").over(Window.partitionBy(key))
    return rows.withColumn("_n", n).withColumn(key, F.when(F.col("_n") > 1, F.raise_error(F.lit(f"repeated {key}"))).otherwise(F.col(key))).drop("_n")


def import_text(old: DataFrame, new: DataFrame, captions: bool = False) -> DataFrame:
    """Imported documents, captions only if wanted, empty ones dropped, later ones winning."""
    ok = new.where(F.trim("text") != "")
    return upsert(old, ok if captions else ok.where("source <> 'caption'"), "doc_id")


def build_vector_store(vectors: DataFrame, path: str, partitions: int) -> None:
    """Vectors by model, clustered by frame_id so that point lookups skip files."""
    vectors.repartitionByRange(partitions, "model", "frame_id").sortWithinPartitions("frame_id").write.mode("overwrite").partitionBy("model").parquet(path)


def build_text_store(docs: DataFrame, path: str, batch: int = 500) -> None:
    """Documents by source, in files of bounded size."""
    docs.write.mode("overwrite").option("maxRecordsPerFile", max(batch, 1_000_000)).partitionBy("source").parquet(path)


def finished_or_checkpoint(finished: DataFrame, running: DataFrame, key: str = "model") -> DataFrame:
    """A model's finished vectors, or those of its unfinished run."""
    return finished.unionByName(running.join(finished.select(key).distinct(), key, "left_anti"))


def config_hash(config: dict) -> str:
    """Eight hex digits of the canonical JSON."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:8]


def plan_is_current(plan: dict, config: dict, dataset: str) -> bool:
    """Approved, and made for this configuration and these data."""
    return plan.get("status") == "APPROVED" and plan.get("config_hash") == config_hash(config) and plan.get("dataset") == dataset


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """A small artefact as one JSON file in a folder."""
    spark.createDataFrame([(json.dumps(value, sort_keys=True, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def job_states(history: DataFrame) -> DataFrame:
    """The current state of each (item_id, stage) of a history (.., status, updated_at, step, error), and how often it failed."""
    key = ["item_id", "stage"]
    tries = history.groupBy(*key).agg(F.sum((F.col("status") == "FAILED").cast("long")).alias("attempts"), F.max_by(F.struct("status", "updated_at", "error"), "step").alias("last"))
    return tries.select(*key, "last.status", "last.updated_at", "attempts", "last.error")


def failures(current: DataFrame, stage: str | None = None) -> DataFrame:
    """Failed and blocked jobs, of one stage or all, the longest untouched first."""
    out = current.where(F.col("status").isin("FAILED", "BLOCKED"))
    return (out if stage is None else out.where(F.col("stage") == stage)).orderBy("updated_at", "item_id", "stage")


def frames_from_names(names: DataFrame) -> DataFrame:
    """Manifest rows of frames known by name alone: (frame_id, video_id, shot_id, frame_index, timestamp_sec: null, frame_path).

    `names` has frame_id such as video_shot_f00000012. The video is the part before
    the first "_", the shot the second part of three or more (else the video's s0),
    the index what follows "_f" (else 0). Files that stand for names give theirs as
    folder_stem. Nothing is made up beyond that: checksums and sizes stay unknown.
    """
    parts = F.split("frame_id", "_")
    video, index = parts[0], F.coalesce(F.nullif(F.regexp_extract("frame_id", r"_f(\d+)", 1), F.lit("")).try_cast("long"), F.lit(0))
    image = F.when(F.col("frame_id").endswith(".jpg"), F.col("frame_id")).otherwise(F.concat("frame_id", F.lit(".jpg")))
    return names.select(
        "frame_id", video.alias("video_id"), F.when(F.size(parts) > 2, F.get(parts, F.lit(1))).otherwise(F.concat(video, F.lit("_s0"))).alias("shot_id"), index.alias("frame_index"),
        F.lit(None).cast("double").alias("timestamp_sec"), F.concat(F.lit("frames/"), video, F.lit("/"), image).alias("frame_path"),
    )


def names_from_files(spark: SparkSession, folder: str) -> DataFrame:
    """(frame_id) of the images below a folder of videos: folder_stem."""
    files = discover(spark, folder, ("jpg",)).select(F.regexp_extract("path", r"([^/]+)/([^/]+)\.[^./]+$", 1).alias("v"), F.regexp_extract("path", r"([^/]+)/([^/]+)\.[^./]+$", 2).alias("s"))
    return files.select(F.concat("v", F.lit("_"), "s").alias("frame_id"))
