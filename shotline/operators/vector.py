"""Vector search: exact cosine top-k, variants, and score lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotline.operators import tiles
from shotline.operators.ranking import top_per


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product in doubles, on the JVM."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: str, epsilon: float = 1e-12) -> Column:
    """x / (|x| + epsilon)."""
    return F.transform(a, lambda x: x.cast("double") / (norm(a) + epsilon))


def cosine(a: str, b: str) -> Column:
    return dot(a, b) / ((norm(a) + 1e-12) * (norm(b) + 1e-12))


def _prepared(df: DataFrame, c: str, length: str) -> DataFrame:
    """The vector in doubles and its length, once a row: pairs then cost one inner product."""
    wide = df.withColumn(c, F.transform(c, lambda x: x.cast("double")))
    return wide.withColumn(length, F.sqrt(_dot(c, c)) + 1e-12)


def _dot(a: str, b: str) -> Column:
    """Inner product of arrays of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.select("query_id", "model", "frame_id", (_dot("embedding", "q") / (F.col("length_e") * F.col("length_q"))).alias("score"))


def scored(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """All (query, frame) scores of a model; `queries` are broadcast, so at most a block of them (see `scored_in_blocks`, which counts)."""
    return _pairs(_prepared(vectors, "embedding", "length_e").join(F.broadcast(_prepared(queries, "q", "length_q")), "model"))


def scored_in_blocks(vectors: DataFrame, queries: DataFrame, size: int = tiles.BLOCK) -> DataFrame:
    """The same, to the bit, for queries that grow with the table: tiles of about `size` queries by a share of the vectors.

    Counts both at once; no task or driver holds all queries.
    """
    return tiles.pairs(vectors, queries, size)


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Best k frames of each query and model; ties by frame_id. A tile's best k are all that is shuffled."""
    return best(tiles.hits(vectors, queries, k), k)


def best(scores: DataFrame, k: int) -> DataFrame:
    return top_per(scores, ["query_id", "model"], [F.desc("score"), F.asc("frame_id")], k)


def max_merge(hits: DataFrame, k: int, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """Union of variants' hits: the best score of each frame."""
    merged = hits.groupBy(*keys, "frame_id").agg(F.max("score").alias("score"))
    return top_per(merged, list(keys), [F.desc("score"), F.asc("frame_id")], k)


def lookup(vectors: DataFrame, frame_id: int, model: str) -> DataFrame:
    """One vector, by a predicate that reaches the scan."""
    return vectors.where((F.col("frame_id") == frame_id) & (F.col("model") == model)).limit(1)


def model_subset(vectors: DataFrame, models: list[str] | None) -> DataFrame:
    """The chosen models' vectors; none chosen: all; none found: an error."""
    if models is None:
        return vectors
    if not models:
        raise ValueError("no model chosen")
    return vectors.where(F.col("model").isin(models))


def pool_size(top_k: int, models: int, least: int = 100) -> int:
    """Hits taken from each list before fusion."""
    return max(top_k, least) if models > 1 else top_k


def positions(frames: DataFrame) -> DataFrame:
    """Frames of one model in order of video, index (null: 0) and id."""
    w = Window.partitionBy("video_id").orderBy(F.coalesce("frame_index", F.lit(0)), "frame_id")
    return frames.withColumn("pos", F.row_number().over(w) - 1)
