"""Quality by a vote of nearest labelled texts in a latent-semantic space.

Terms are words (hashed, case-folded), shapes of tokens (runs of lower-case and
capital letters, digits and each symbol) and a word that repeats the one before.
A text's vector holds the square roots of its terms' shares, rarer words weighing
more: how many documents hold each of the fixed bins is counted over all of them,
in a narrow pass of `WIDTH` numbers a task. The latent space is spanned by the
leading right singular vectors of the labelled ones. Those (about `REFERENCES`, a
documented bound) are broadcast; every document's cosine with all of them is
computed exactly, in blocks of one matrix product per batch, and its `NEIGHBOURS`
nearest vote, each weighted by a power of its similarity; of equally near ones
those with the least doc_id.

Null and empty texts have a zero vector and score the labelled share of ones; so
does every text if no row is labelled (0.5 then). Repeated rows are scored one by
one; null doc_ids are held out; an empty table gives an empty result; further
columns are ignored (and kept by `keep_documents`).
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotline.llm import common
from shotline.llm.bpe import Cache
from shotline.llm.toxicity import fold, sampled

#: Labelled vectors, and dimensions of the space.
REFERENCES, DIMENSIONS = 4_096, 48
NEIGHBOURS, POWER = 15, 24
WORD_BINS, SHAPE_BINS = 2_048, 256
WIDTH = WORD_BINS + SHAPE_BINS + 1
#: Weights of the blocks of terms: words, shapes, repeats.
BLOCKS = (0.5, 1.0, 1.0)
THRESHOLD = 0.3
_RUNS = ((re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), "a"), (re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"\d+"), "9"), (re.compile(r"([^\w])\1+"), r"\1"))


def _letters(word: str) -> str | None:
    """The shape of a word of letters that are all small, or all but a capital first one; None for others."""
    if word.islower():
        return "a"
    first = word[0]
    return "Aa" if ("A" <= first <= "Z" or "À" <= first <= "Þ") and word[1:].islower() else None


def shape(token: str) -> str:
    """Runs of small letters, capitals, digits and of one symbol as one character each, eight at most."""
    if token.isalpha():
        known = _letters(token)
    elif token[-1] in ".,!?;:" and token[:-1].isalpha():
        known = (base := _letters(token[:-1])) and base + token[-1]
    else:
        known = None
    if known:  # most tokens
        return known
    for pattern, to in _RUNS:
        token = pattern.sub(to, token)
    return token[:8]


@lru_cache(4096)
def _shape_bin(of: str) -> int:
    return zlib.crc32(of.encode("utf-8", "surrogatepass")) % SHAPE_BINS


def _code(token: str) -> int:
    """Bins of a token's word and shape, in one number."""
    word = zlib.crc32(token.lower().strip(".,!?;:#$%&*|").encode("utf-8", "surrogatepass")) % WORD_BINS
    return word * SHAPE_BINS + _shape_bin(shape(token))


_codes = Cache(_code)


def terms(text: str) -> np.ndarray:
    """Square roots of the shares of words, shapes and repeats."""
    out = np.zeros(WIDTH, np.float32)
    tokens = text.split()
    if tokens:
        codes = np.fromiter(map(_codes.__getitem__, tokens), np.int64, len(tokens))
        out[:WORD_BINS] = np.bincount(codes // SHAPE_BINS, minlength=WORD_BINS)
        out[WORD_BINS:-1] = np.bincount(codes % SHAPE_BINS, minlength=SHAPE_BINS)
        out[-1] = np.count_nonzero(codes[1:] == codes[:-1])
        np.sqrt(out / len(tokens), out)
    return out


@dataclass(frozen=True)
class Model:
    """What is broadcast: scales of terms, the space, labelled vectors, labels and their mean."""

    scales: np.ndarray
    space: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    mean: float

    def project(self, x: np.ndarray) -> np.ndarray:
        z = (x * self.scales) @ self.space
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """One block: exact cosines with all labelled vectors, and the weighted vote."""
        if not len(self.labels) or not len(x):
            return np.full(len(x), self.mean)
        z = self.project(x)
        near = z @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        least = np.take_along_axis(near, at, 1).min(1, keepdims=True)
        for row in np.flatnonzero(np.count_nonzero(near >= least, axis=1) > k):  # ties at the last place
            at[row] = np.argsort(-near[row], kind="stable")[:k]
        weight = np.clip(np.take_along_axis(near, at, 1), 0, 1).astype(np.float64) ** POWER
        total = weight.sum(1)
        vote = (weight * self.labels[at]).sum(1) / np.maximum(total, 1e-12)
        return np.where(total > 1e-9, np.clip(vote, 0, 1), self.mean)


def _leading(x: np.ndarray, k: int) -> np.ndarray:
    """Leading right singular vectors, by randomised subspace iteration with a fixed seed."""
    rng = np.random.default_rng(5)
    q = np.linalg.qr(x.T @ (x @ rng.standard_normal((x.shape[1], k + 16)).astype(np.float32)))[0]
    for _ in range(3):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T[:, :k]).astype(np.float32)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The number of documents, and how many of them hold each of the `WIDTH` terms; WIDTH rows come to the driver."""

    def run(batches):
        held = np.zeros(WIDTH + 1, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                held[:-1] += terms(text) > 0
            held[-1] += batch.num_rows
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at], pa.int64())], ["term", "n"])

    common.bound_batches(docs.sparkSession)
    got = common.texts(docs).select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(WIDTH + 1, np.int64)
    out[got.term.to_numpy(np.int64)] = got.n.to_numpy()
    return int(out[-1]), out[:-1]


def fit(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", rows: int = REFERENCES) -> Model:
    """Labelled vectors of a bounded sample of the rows that `train` chooses."""
    chosen = F.broadcast(sampled(labels, label, train, rows))  # bounded by `rows`

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [terms(t) for t in batch.column("text").to_pylist()]
        at = [np.flatnonzero(x) for x in found]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("y"), pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())), pa.array([x[a] for x, a in zip(found, at, strict=True)], pa.list_(pa.float32()))],
            ["doc_id", "y", "at", "x"],
        )

    sample = common.texts(docs).join(chosen, "doc_id").withColumn("y", F.col("y").cast("double"))
    got = common.over_batches(sample, run, "doc_id long, y double, at array<int>, x array<float>").toPandas().sort_values("doc_id", kind="stable")
    if not len(got):
        return Model(np.ones(WIDTH, np.float32), np.eye(WIDTH, 1, dtype=np.float32), np.empty((0, 1), np.float32), np.empty(0), 0.5)
    x = np.zeros((len(got), WIDTH), np.float32)
    for k, (a, v) in enumerate(zip(got["at"], got["x"], strict=True)):
        x[k, np.asarray(a, np.int64)] = v
    n, held = document_frequencies(docs)
    idf = np.log((1 + n) / (1 + held))
    scales = np.concatenate([idf[:WORD_BINS] / max(1e-6, idf[:WORD_BINS].mean()) * BLOCKS[0], np.full(SHAPE_BINS, BLOCKS[1]), [BLOCKS[2]]]).astype(np.float32)
    x *= scales
    space = _leading(x, min(DIMENSIONS, len(x)))
    z = x @ space
    return Model(scales, space, (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)).astype(np.float32), got.y.to_numpy(), float(got.y.mean()))


def score_documents(docs: DataFrame, model: Broadcast, held_out: Column) -> DataFrame:
    """(doc_id, held_out, score) by one narrow pass."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([terms(t) for t in batch.column("text").to_pylist()], np.float32).reshape(-1, WIDTH)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(model.value.scores(x), pa.float64())], ["doc_id", "held_out", "score"])

    return common.over_batches(common.texts(docs, held_out.alias("held_out")), run, "doc_id long, held_out boolean, score double")


def keep_documents(docs: DataFrame, model: Broadcast, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score at least the threshold, with their own columns."""

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        x = np.array([terms(t or "") for t in text], np.float32).reshape(-1, WIDTH)
        return pd.Series(model.value.scores(x))

    common.bound_batches(docs.sparkSession)
    return docs.where(score(F.col("text")) >= threshold)


def op2_quality_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; labels of four folds of five are learned from."""
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    held = F.coalesce(fold(5) == 0, F.lit(True))
    model = spark.sparkContext.broadcast(fit(docs, labels, ~held))
    out = score_documents(docs, model, held)
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
