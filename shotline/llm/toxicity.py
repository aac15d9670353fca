"""Toxicity of restored text.

Disguised words are restored first (see `deobfuscation`). Evidence is a word or
one of its beginnings of four to eight letters. On a bounded sample (`FIT_ROWS`)
of distinct labelled texts, evidence with a significant association is kept and a
logistic regression fitted on how many distinct words of a text hold it (at most
`MOST` counted). A text's score is the regression's probability.

Null and empty texts score the regression's constant; very long tokens are
decoded whole; repeated rows are scored one by one; a text that is labelled
toxic once is learned as toxic, however often it is labelled otherwise; null
doc_ids are held out and not learned from; without labelled rows of both kinds
every text scores `PRIOR`; an empty table gives an empty result; further columns
are ignored. A word cut by a single space isn't restored ("id iot"): its parts
are tokens of their own.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotline.llm import common, deobfuscation
from shotline.llm.bpe import Cache

#: Labelled texts that weights are fitted on, at most about; entries of the table of weights.
FIT_ROWS = 10_000
TABLE_ENTRIES = 8_192
PRIOR = 0.02
#: Lengths of a word's beginnings, least G² of an association, words counted for one evidence.
STEMS, LEAST_G2, MOST = (4, 5, 6, 7, 8), 12.0, 3
#: Strength of the regression's penalty, and its steps.
RIDGE, STEPS = 1.0, 400
THRESHOLD = 0.3


def sampled(labels: DataFrame, label: str, train: Column, rows: int) -> DataFrame:
    """(doc_id, y) of about `rows` labelled training rows, by a hash of their ids: a bounded table."""
    known = labels.where(train & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).alias("y"))
    n = known.count()
    share = min(1.0, rows / max(1, n))
    return known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))


def words(text: str, surprise: np.ndarray, restored: Cache) -> set[str]:
    """The distinct words of a text, disguised ones restored."""
    text = text.lower()
    out: set[str] = set()
    for token in set(text.split()):
        out.update(restored[token])
    for run in deobfuscation.spaced(text):
        out.update(deobfuscation.restore(run, surprise).split())
    return out


def plain(token: str, surprise: np.ndarray) -> tuple[str, ...]:
    """The words of each reading of a token; one that isn't surely disguised also stands as it is."""
    core = deobfuscation.trimmed(token)
    own = [core] if core and not deobfuscation.suspicious(core) else []
    return tuple(dict.fromkeys([*own, *(w for x in deobfuscation.readings(token) for w in deobfuscation.restore(x, surprise).split())]))


def evidence(word: str) -> list[str]:
    """What a word may be known by."""
    return [word] + [f"{word[:n]}-" for n in STEMS if len(word) > n]


def collapsed_evidence(known: dict[str, int]) -> tuple[set[str], tuple[int, ...]]:
    """Known evidence with repeats dropped, words and beginnings apart, and the lengths of those beginnings."""
    out = {deobfuscation.collapsed(e.removesuffix("-")) + "-" * e.endswith("-") for e in known}
    return out, tuple(sorted({len(e) - 1 for e in out if e.endswith("-")}))


def holds_nothing(letters: str, short: set[str], lengths: tuple[int, ...]) -> bool:
    """Whether a word of letters can't hold known evidence, whatever repeats are dropped: what it holds begins like it without repeats."""
    one = deobfuscation.collapsed(letters)
    return one not in short and not any(one[:n] + "-" in short for n in lengths)


def _counts(sample: DataFrame, surprise: Broadcast) -> DataFrame:
    """(evidence, toxic, other): distinct sampled texts that hold it; (null, ...) counts the texts."""

    def run(batches):
        toxic, other = Counter(), Counter()
        restored = Cache(lambda t: plain(t, surprise.value))
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                (toxic if y else other).update({None, *(e for w in words(text, surprise.value, restored) for e in evidence(w))})
        keys = [*toxic, *(k for k in other if k not in toxic)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([other[k] for k in keys], pa.int64())], ["evidence", "toxic", "other"])

    common.bound_batches(sample.sparkSession)
    found = sample.select("text", "y").mapInArrow(run, "evidence string, toxic long, other long")
    return found.groupBy("evidence").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _g2(a: Column, b: Column, n_a: float, n_b: float) -> Column:
    """Log-likelihood ratio of a of n_a against b of n_b."""
    share = (a + b) / F.lit(n_a + n_b)
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(F.lit(0.0))
    out = part(a, share * n_a) + part(b, share * n_b) + part(n_a - a, (1 - share) * n_a) + part(n_b - b, (1 - share) * n_b)
    return 2 * out


def held_by(found: set[str], known: dict[str, int]) -> Counter:
    """How many of the words hold each known evidence."""
    return Counter(known[e] for w in found for e in evidence(w) if e in known)


def _regression(rows: list[tuple[float, list[int], list[int]]], n: int) -> tuple[np.ndarray, float]:
    """Weights and constant of a ridge logistic regression, by accelerated gradient steps."""
    y = np.array([r[0] for r in rows])
    doc = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    at = np.concatenate([np.array(r[1], np.int64) for r in rows])
    x = np.minimum(np.concatenate([np.array(r[2], float) for r in rows]), MOST)
    w = v = np.zeros(n + 1)
    norm = np.zeros(n) + 1e-9
    np.add.at(norm, at, x * x)
    rate = 1 / np.concatenate([0.25 * norm + RIDGE, [0.25 * len(y)]]) / 4
    for k in range(STEPS):
        z = v[-1] + np.bincount(doc, v[at] * x, len(y))
        e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.concatenate([np.bincount(at, e[doc] * x, n) + RIDGE * v[:-1], [e.sum()]])
        new = v - rate * grad
        v, w = new + k / (k + 3) * (new - w), new
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, train: Column, surprise: Broadcast, label: str = "toxic", rows: int = FIT_ROWS) -> tuple[dict[str, float], float]:
    """(evidence -> weight, constant); `train` chooses the labels' rows to learn from."""
    spark = docs.sparkSession
    chosen = F.broadcast(sampled(labels, label, train, rows))  # bounded by `rows`
    sample = common.texts(docs).join(chosen, "doc_id").groupBy("text").agg(F.max(F.col("y").cast("int")).alias("y"))
    sample = common.checkpointed(sample)
    counts = common.checkpointed(_counts(sample, surprise))
    total = counts.where("evidence is null").first()
    none = {}, math.log(PRIOR / (1 - PRIOR))
    if total is None or not total.toxic or not total.other:
        return none
    n_a, n_b = float(total.toxic), float(total.other)
    a, b = F.col("toxic").cast("double"), F.col("other").cast("double")
    kept = counts.where("evidence is not null and toxic > 0").withColumn("g2", _g2(a, b, n_a, n_b))
    kept = kept.where((F.col("g2") >= LEAST_G2) & (a * n_b > b * n_a)).orderBy(F.desc("g2"), "evidence").limit(TABLE_ENTRIES)
    known = {r.evidence: k for k, r in enumerate(kept.select("evidence").toLocalIterator())}
    if not known:
        return none
    table = spark.sparkContext.broadcast(known)

    def run(batches):
        restored = Cache(lambda t: plain(t, surprise.value))
        for batch in batches:
            held = [held_by(words(t, surprise.value, restored), table.value) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y").cast(pa.float64()), pa.array([list(h) for h in held], pa.list_(pa.int64())), pa.array([list(h.values()) for h in held], pa.list_(pa.int64()))], ["y", "at", "n"])

    got = [(r.y, r.at, r.n) for r in sample.mapInArrow(run, "y double, at array<long>, n array<long>").collect()]  # bounded by `rows`
    weights, constant = _regression(got, len(known))
    return {e: float(weights[k]) for e, k in known.items()}, constant


def score_documents(docs: DataFrame, weights: dict[str, float], constant: float, surprise: Broadcast, held_out: Column) -> DataFrame:
    """(doc_id, held_out, score, n_restored) by one narrow pass."""
    table = docs.sparkSession.sparkContext.broadcast((list(weights.values()), {e: k for k, e in enumerate(weights)}))

    def run(batches):
        (weight, known), lm = table.value, surprise.value
        short, lengths = collapsed_evidence(known)

        def found_in(parts: tuple[str, ...]) -> dict[str, list[int]]:
            return {w: at for w in parts if (at := [known[e] for e in evidence(w) if e in known])}

        def looked_up(token: str) -> tuple[dict[str, list[int]], bool] | None:
            letters = deobfuscation.plain_letters(token)
            if letters and holds_nothing(letters, short, lengths):
                return ({}, True) if deobfuscation.suspicious(letters) else None
            core = deobfuscation.trimmed(token)
            odd = bool(core) and deobfuscation.suspicious(core)
            found = found_in(plain(token, lm))
            return (found, odd) if found or odd else None

        cache = Cache(looked_up)
        for batch in batches:
            scores, restored = [], []
            for text in batch.column("text").to_pylist():
                text = text.lower()
                found: dict[str, list[int]] = {}
                n = 0
                for x in filter(None, map(cache.__getitem__, set(text.split()))):
                    found |= x[0]
                    n += x[1]
                for part in deobfuscation.spaced(text):
                    found |= found_in(tuple(deobfuscation.restore(part, lm).split()))
                    n += 1
                z = constant + sum(weight[k] * min(MOST, c) for k, c in sorted(Counter(k for at in found.values() for k in at).items()))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                restored.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array(restored, pa.int64())], ["doc_id", "held_out", "score", "n_restored"])

    common.bound_batches(docs.sparkSession)
    return common.texts(docs, held_out.alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, n_restored long")


def fold(modulus: int) -> Column:
    """crc32 of doc_id as text, mod `modulus`."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; labels of three folds of four are learned from."""
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    held = F.coalesce(fold(4) == 2, F.lit(True))
    surprise = spark.sparkContext.broadcast(deobfuscation.model(deobfuscation.trigram_counts(docs)))
    weights, constant = fit(docs, labels, ~held, surprise)
    out = score_documents(docs, weights, constant, surprise, held)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_restored")
