"""What the training-data operators share: reading, batches, shared folders."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: bounds a Python worker's memory however long the texts are.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20
#: Bits of a bitmap over hashed keys: 2^26 bits are 8 MB, whatever the number of keys.
BITMAP_BITS = 26
ROWS_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
BYTES_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables, by whatever path Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Set the Arrow batch bounds unless the session has its own."""
    if spark.conf.get(ROWS_CONF, "10000") == "10000":
        spark.conf.set(ROWS_CONF, str(BATCH_ROWS))
    if spark.conf.get(BYTES_CONF, None) is None:
        spark.conf.set(BYTES_CONF, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares (``spark.checkpoint.dir``).

    Only where that setting is absent and the master is local, as in tests, a local folder is set; on a cluster its
    absence is an error, since executors don't share local folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
        if not found:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
            found = f"file://{tempfile.gettempdir()}/checkpoints"
            spark.sparkContext.setCheckpointDir(found)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, kind: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, wherever it lies."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def texts(docs: DataFrame, *more: str | Column) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) alone, so that further columns can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def over_batches(df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch] | None], schema: str) -> DataFrame:
    """``mapInArrow`` by bounded batches; `rows` gets and returns record batches."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = rows(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            elif out is not None:
                yield from out

    return df.mapInArrow(run, schema)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def cpu_threads_off() -> None:
    """One thread for each task: Spark schedules the cores."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def bitmap(keys: DataFrame, key: Column) -> np.ndarray:
    """Marks the low BITMAP_BITS bits of each key (a long); at most 2^BITMAP_BITS / 64 rows come to the driver."""
    at = keys.select(key.bitwiseAND((1 << BITMAP_BITS) - 1).alias("b"))
    words = at.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v")).toPandas()
    out = np.zeros((1 << BITMAP_BITS) // 64, np.uint64)
    out[words.w.to_numpy(np.int64)] = words.v.to_numpy(np.int64).view(np.uint64)
    return out


def is_marked(marks: np.ndarray, key: int) -> bool:
    b = key & ((1 << BITMAP_BITS) - 1)
    return bool(int(marks[b >> 6]) >> (b & 63) & 1)


def marked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents whose id is in `ids` (doc_id), and of few others.

    A narrow pass: only such texts leave the map side. If the bitmap saturates,
    more texts pass; callers join by doc_id, so the result stays the same.
    """
    spark = docs.sparkSession
    marks = spark.sparkContext.broadcast(bitmap(ids, F.xxhash64("doc_id")))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        b = batch.column("slot").to_numpy() & ((1 << BITMAP_BITS) - 1)
        on = (marks.value[b >> 6] >> (b & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return batch.select(["doc_id", "text"]).filter(pa.array(on))

    rows = texts(docs, F.xxhash64(F.col("doc_id").cast("long")).alias("slot")).where("doc_id is not null")
    return over_batches(rows, run, "doc_id long, text string")
