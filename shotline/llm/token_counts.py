"""Token counts by a two-tier lookup on the map side.

Tier one is a compact table of the corpus's most frequent chunks and their
numbers of ids, broadcast; its size is fixed by `TABLE_ENTRIES`. Tier two is a
bounded cache in each Python worker that encodes what the table misses. The
occurrences of pre-tokens are never shuffled: one narrow pass counts.

The table is made from all documents: every task keeps a bounded summary of its
chunks and emits its `TASK_ENTRIES` most frequent ones, and only those summaries
are added up. The table decides speed alone; counts are exact with any table.

Nulls and empty texts have 0 tokens and 0 bytes; repeated rows are counted one
by one; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache
from itertools import islice

import public_tokenizers
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotline.llm import common
from shotline.llm.bpe import LONGEST_KEPT, Cache, byte_bpe

#: Entries of the broadcast table, and of each task's contribution to it.
TABLE_ENTRIES = 32_768
TASK_ENTRIES = 4_096
#: A task's summary is cut to half when it has this many entries.
SUMMARY_ENTRIES = 200_000
TOKENS_LIMIT = 1024


def frequent_chunks(docs: DataFrame, path: str, entries: int = TABLE_ENTRIES) -> DataFrame:
    """(chunk, n): the most frequent chunks of all texts, by merged bounded summaries."""

    def count(batches):
        bpe, seen = byte_bpe(path), Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(islice((text and bpe.chunks(text)) or (), 1, None))
            if len(seen) > SUMMARY_ENTRIES:
                seen = Counter(dict(seen.most_common(SUMMARY_ENTRIES // 2)))
        top = [(c, n) for c, n in seen.most_common(TASK_ENTRIES) if len(c) <= LONGEST_KEPT]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["chunk", "n"])

    common.bound_batches(docs.sparkSession)
    found = common.texts(docs).select("text").mapInArrow(count, "chunk string, n long")
    return found.groupBy("chunk").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "chunk").limit(entries)


def length_table(docs: DataFrame, path: str, entries: int = TABLE_ENTRIES) -> Broadcast:
    """The compact table, broadcast: chunks joined by spaces, and a byte (or more) of length each."""
    chunks = [r.chunk for r in frequent_chunks(docs, path, entries).toLocalIterator()]
    bpe = byte_bpe(path)
    lengths = [len(bpe.later_chunk(c)) for c in chunks]
    return docs.sparkSession.sparkContext.broadcast((" ".join(chunks), lengths))


class Lengths(dict):
    """Tier one; what it misses is asked of tier two."""

    def __init__(self, frequent, path: str):
        super().__init__(frequent)
        bpe = byte_bpe(path)
        self.rare = Cache(lambda c: len(bpe.later_chunk(c)))

    def __missing__(self, chunk: str) -> int:
        return self.rare[chunk]


@lru_cache(2)
def _lengths(key: int, path: str) -> list:
    return []


def _lookup(table: Broadcast, path: str) -> Lengths:
    """One for each worker process and table."""
    kept = _lengths(table._jid if hasattr(table, "_jid") else id(table), path)
    if not kept:
        chunks, lengths = table.value
        kept.append(Lengths(zip(chunks.split(" ") if chunks else (), lengths, strict=True), path))
    return kept[0]


def count_tokens(docs: DataFrame, path: str, table: Broadcast | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every text, by one narrow pass."""
    table = table or length_table(docs, path)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe, lookup = byte_bpe(path), _lookup(table, path)
        n_bytes, n_tokens = [], []
        for text in batch.column("text").to_pylist():
            n_bytes.append(len(text.encode()))
            found = bpe.chunks(text) if text else None
            if found is None:
                n_tokens.append(len(bpe.ids(text)) if text else 0)
            else:
                n_tokens.append(len(bpe.chunk(found[0])) + sum(map(lookup.__getitem__, islice(found, 1, None))))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return common.over_batches(common.texts(docs), count, "doc_id long, n_bytes long, n_tokens long")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents by the 50k byte-level vocabulary."""
    docs = common.table(spark, sf_dir, "documents")
    out = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > TOKENS_LIMIT)
