"""Token ids as files of independent zstandard frames, in ascending doc_id order.

Texts are dealt out by ranges of doc_id and sorted there; each task encodes its
documents and closes a segment (see `seekable`) whenever its ids reach
`SEGMENT_BYTES`, so memory doesn't depend on a partition's size. Spark's own text
writer puts each segment into a file of its own through the commit protocol, on
any file system, and writes the seek table's closing magic number as its line
end: a lost task leaves nothing behind and is run again.

Null doc_ids (and -2^63, which stands for them in the index) sort first and come back null; rows with equal doc_id follow each
other ordered by a hash of the text, then the text; null and empty texts hold the
end id alone; an empty table gives no segment and an empty result; further
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shotline.llm import common, seekable
from shotline.llm.bpe import word_bpe

#: Bytes of ids after which a segment is closed.
SEGMENT_BYTES = 8 << 20
END_ID = 2
LEVEL = 3


def write(docs: DataFrame, path: str, folder: str, end_id: int = END_ID, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Encode all documents and write the files into `folder`."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    rows = common.texts(docs).withColumn("h", F.xxhash64("text"))
    dealt = rows.repartitionByRange(common.partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    last = np.array([end_id], "<u4").tobytes()

    def encode(batches):
        bpe, zip_, partition = word_bpe(path), seekable.compressor(LEVEL), TaskContext.get().partitionId()
        number, held, kept = 0, 0, ([], [], [], [])

        def closed():
            payload = seekable.segment(partition, number, *kept)
            return pa.RecordBatch.from_arrays([pa.array([payload[: -len(seekable.END)]], pa.binary())], ["payload"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                content = bpe.encode(text) + last
                for to, x in zip(kept, (seekable.NULL_ID if doc_id is None else doc_id, zip_.compress(content), len(content), seekable.checksum(content)), strict=True):
                    to.append(x)
                held += len(content)
                if held >= segment_bytes:
                    yield closed()
                    number, held, kept = number + 1, 0, ([], [], [], [])
        if kept[0]:
            yield closed()

    segments = dealt.select("doc_id", "text").mapInArrow(encode, "payload binary")
    magic = seekable.END.decode("latin-1")
    segments.select(F.col("payload").cast("string").alias("value")).write.option("compression", "none").option("encoding", "ISO-8859-1").option("lineSep", magic).option("maxRecordsPerFile", 1).text(folder)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    common.bound_batches(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).where("length > 0").select("content")


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """(partition, segment, n_ids, start): of each file, from its seek table alone."""

    def heads(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [seekable.Segment(x.as_py()) for x in batch.column("content")]
        return pa.RecordBatch.from_arrays([pa.array([getattr(s, k) for s in found], pa.int64()) for k in ("partition", "number")] + [pa.array([int(s.sizes.sum()) // 4 for s in found], pa.int64())], ["partition", "segment", "n_ids"])

    rows = common.over_batches(_files(spark, folder), heads, "partition long, segment long, n_ids long")
    before = Window.orderBy("partition", "segment").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))  # one row a file


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read back from the files and checked."""

    def read(batch: pa.RecordBatch):
        for x in batch.column("content"):
            s = seekable.Segment(x.as_py())
            n = s.sizes // 4
            crc = [zlib.crc32(s.content(k)) for k in range(len(n))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(n), s.partition), pa.int64()), pa.array(np.full(len(n), s.number), pa.int64()),
                    pa.array(s.doc_ids, pa.int64(), mask=s.doc_ids == seekable.NULL_ID), pa.array(np.cumsum(n) - n, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()),
                ],
                ["partition", "segment", "doc_id", "ahead", "n_tokens", "ids_crc32"],
            )

    rows = common.over_batches(_files(spark, folder), read, "partition long, segment long, doc_id long, ahead long, n_tokens long, ids_crc32 long")
    starts = segments(spark, folder).select("partition", "segment", "start")
    return rows.join(starts, ["partition", "segment"]).select("doc_id", (F.col("start") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32")


def ids(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of the requested documents; only their frames are decompressed."""

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [y for x in batch.column("content") for y in seekable.Segment(x.as_py()).read(doc_ids)]
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([a.astype(np.int64) for _, a in found], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return common.over_batches(_files(spark, folder), read, "doc_id long, ids array<long>")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids by the 49k word vocabulary, and read the files back."""
    folder = common.fresh_dir(spark, "token-files")
    write(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return documents(spark, folder)
