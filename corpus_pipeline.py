"""Corpus preparation: documents to packed training sequences.

Five stages, each an operator of ``shotline.llm``: (1) the quality classifier
removes documents it rejects, (2) quality rules remove those that fail, (3) one
document of each near-duplicate class stays, (4) personal data is replaced,
(5) what is left is packed. All but the last return the columns of documents.

Null texts count as empty: the vote scores both with the share of good labels, the
rules drop them (fewer than 20 words). Rows that repeat a doc_id are judged one by
one; of equal texts one row stays, of different texts under one doc_id each. Rows
without doc_id aren't learned from and are nobody's duplicate; their pieces have a
null doc_id. Of equally near labelled texts those with the least doc_id vote, of a
class the least doc_id stays. Very long texts are read, redacted and packed whole.
Empty tables give an empty result; without labels every document passes the vote.
Further columns of documents are kept, whatever their names, up to the packing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotline.llm import common, near_duplicates, packing, pii, quality_rules, quality_vote


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour vote accepts; labels come from the table beside the documents."""
    held = F.coalesce(quality_vote.fold(5) == 0, F.lit(True))
    model = spark.sparkContext.broadcast(quality_vote.fit(docs, common.table(spark, sf_dir, "labels"), ~held))
    return quality_vote.keep_documents(docs, model)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate class."""
    return near_duplicates.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced, their length renewed."""
    out = pii.redact_documents(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", classify_quality),
    ("quality rules", apply_rules),
    ("near-duplicates", drop_near_duplicates),
    ("personal data", redact),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder, since the next reads it more than once.

    A result goes when the one after it is written. The last one's input stays, as its rows are read when the caller asks.
    """
    docs, before = common.table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            folder = common.fresh_dir(spark, f"pipeline-{k}")
            out.write.parquet(folder)
            out = spark.read.parquet(folder)
            if before:
                common.remove_dir(spark, before)
            before = folder
        docs = out
    return docs


#: Fitted votes and hashed signatures have no SQL; the stages are tested against brute force.
ORACLE_SQL = None
