"""Canonical exact digests of documents, and classes of equal ones.

A text is normalised (NFKC), case-folded, normalised again and its white space
folded to single spaces; its fingerprint is the 128-bit xxHash (XXH3) of the
result's UTF-8. Two fingerprints are alike by 1.0 if equal, else by 0.0.

Classes: digests that occur once are classes of their own. Documents that share
a digest are compared byte by byte. Only their texts are shuffled: a bitmap of
fixed size (`common.BITMAP_BITS`) over digest prefixes, built by an aggregation,
tells map tasks which texts to send; if it saturates, more texts travel and the
result stays the same. Each task compares its own texts first and sends equal
ones once, with their doc_ids, holding `COMBINE_BYTES` at a time. One shuffle
brings a bucket together, sorted by its bytes; a stream compares each text with
the one before it, so a bucket is never collected, and texts that share a digest
but not their bytes (a collision) are classes of their own.

Null texts count as empty; empty texts share a fingerprint. Null doc_ids (and
-2^63, which stands for them in the sort) come before all others; a null keeps a
null class; rows of one doc_id are ordered by a hash of the text; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotline.llm import common

_OWN, _AHEAD, _WRAPPED = 0, 1, 2
_LEAST = -(1 << 63)
#: Equal texts of one task are combined before they are sent; this many bytes are held at a time.
COMBINE_BYTES = 16 << 20


def canonical(text: str) -> str:
    """Unicode, case and white space folded."""
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    text = text.casefold()
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return " ".join(text.split())


def digest(text: str) -> str:
    return xxhash.xxh3_128_hexdigest(canonical(text).encode())


def likeness(one: str, other: str) -> float:
    return 1.0 if one == other else 0.0


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) by one narrow pass."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(digest, batch.column("text").to_pylist()), pa.string())], ["doc_id", "fingerprint"])

    return common.over_batches(common.texts(docs), run, "doc_id long, fingerprint string")


def _hash(data: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(data)


def classes(docs: DataFrame, found: DataFrame, hashed: Callable[[bytes], str] = _hash) -> DataFrame:
    """(doc_id, fingerprint, class_id) of documents that share a digest, by byte comparison.

    `found` has (doc_id, fingerprint) of all documents, `hashed` of canonical bytes;
    the class is its least doc_id.
    """
    spark = docs.sparkSession
    shared = found.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1")
    bitmap = spark.sparkContext.broadcast(common.bitmap(shared, F.conv(F.substring("fingerprint", 1, 12), 16, 10).cast("long")))

    def flushed(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([min(ids) for _, ids in held.values()], pa.int64()), pa.array([ids for _, ids in held.values()], pa.list_(pa.int64())), pa.array([n for n, _ in held.values()], pa.string()), pa.array(list(held), pa.binary())],
            ["least", "ids", "fingerprint", "data"],
        )

    def run(batches):
        marks, held, size = bitmap.value, {}, 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = canonical(text).encode()
                known = held.get(data)
                if known:
                    known[1].append(doc_id)
                    size += 16
                else:
                    name = hashed(data)
                    if common.is_marked(marks, int(name[:12], 16)):
                        held[data] = (name, [doc_id])
                        size += len(data) + 256
                if size > COMBINE_BYTES:
                    yield flushed(held)
                    held, size = {}, 0
        yield flushed(held)

    common.bound_batches(spark)
    sent = common.texts(docs).where("doc_id is not null").mapInArrow(run, "least long, ids array<long>, fingerprint string, data binary")
    sent = sent.repartition(common.partitions(spark), "fingerprint").sortWithinPartitions("fingerprint", "data", "least")

    def compare(batches):
        last = first = None
        for batch in batches:
            out = []
            for least, name, data in zip(*(batch.column(c).to_pylist() for c in ("least", "fingerprint", "data")), strict=True):
                if (name, data) != last:
                    last, first = (name, data), least
                out.append(first)
            yield pa.RecordBatch.from_arrays([batch.column("ids"), batch.column("fingerprint"), pa.array(out, pa.int64())], ["ids", "fingerprint", "class_id"])

    out = sent.mapInArrow(compare, "ids array<long>, fingerprint string, class_id long")
    return out.select(F.explode("ids").alias("doc_id"), "fingerprint", "class_id").distinct()


def edited(text: str, following: str) -> str:
    """The second half's code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


@lru_cache(1)
def _zip() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=1)


@lru_cache(1)
def _unzip() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def _dealt(docs: DataFrame) -> DataFrame:
    """(range, kind, doc_id, data: the text, compressed) by ranges of doc_id, each range followed by the next one's first row (the last by the very first)."""
    spark = docs.sparkSession
    rows = common.texts(docs).withColumn("at", F.coalesce("doc_id", F.lit(_LEAST)))
    n = common.partitions(spark)
    parts = F.array(*[F.lit(i / n) for i in range(1, n)]) if n > 1 else F.array(F.lit(0.5))
    least, cuts = rows.agg(F.min("at"), F.percentile_approx("at", parts, 10_000)).first()
    bounds = np.array(sorted({c for c in (cuts or []) if c > least}) if n > 1 else [], np.int64)

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.column("at").to_numpy()
        own = np.searchsorted(bounds, at, side="right").astype(np.int32)
        first = np.flatnonzero((own > 0) & (np.concatenate([[_LEAST], bounds])[own] == at))  # also closes the range before
        wrapped = np.flatnonzero(at == least)
        taken = np.concatenate([np.arange(len(at)), first, wrapped])
        range_ = np.concatenate([own, own[first] - 1, np.full(len(wrapped), len(bounds))]).astype(np.int32)
        kind = np.repeat(np.array([_OWN, _AHEAD, _WRAPPED], np.int32), [len(at), len(first), len(wrapped)])
        data = pa.array([_zip().compress(t) for t in batch.column("text").cast(pa.binary()).to_pylist()], pa.binary())
        kept = [batch.column(c).take(pa.array(taken)) for c in ("doc_id", "at", "h")]
        return pa.RecordBatch.from_arrays([pa.array(range_), pa.array(kind), *kept, data.take(pa.array(taken))], ["range", "kind", "doc_id", "at", "h", "data"])

    dealt = common.over_batches(rows.select("doc_id", "text", "at", F.xxhash64("text").alias("h")), spread, "range int, kind int, doc_id long, at long, h long, data binary")
    dealt = dealt.repartitionById(len(bounds) + 1, F.col("range"))
    return dealt.sortWithinPartitions("range", F.col("kind") == _WRAPPED, "at", "h", "data").select("range", "kind", "doc_id", "data")


def edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness (see the query)."""
    common.bound_batches(docs.sparkSession)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        before, done = None, False  # (range, doc_id, text, digest); whether its range has seen the row ahead
        for batch in batches:
            rows = []
            for at, kind, doc_id, data in zip(*(batch.column(c).to_pylist() for c in ("range", "kind", "doc_id", "data")), strict=True):
                if before and before[0] != at:
                    before, done = None, False
                if done:
                    continue
                text = _unzip().decompress(data).decode()
                name = digest(text)
                if before:
                    _, last_id, last, last_name = before
                    changed = edited(last, text)
                    changed_name = digest(changed)
                    rows.append((last_id, len(last), hashlib.sha256(changed.encode()).hexdigest(), last_name, changed_name, likeness(last_name, changed_name), likeness(last_name, name)))
                before, done = (at, doc_id, text, name), kind != _OWN
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return _dealt(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts, with classes of equal documents."""
    docs = common.table(spark, sf_dir, "documents")
    found = common.checkpointed(edits(docs))
    same = classes(docs, found)
    return found.join(same, ["doc_id", "fingerprint"], "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
