"""Models as a boundary: interfaces, and how their batches meet DataFrames.

Inference isn't an operator here. A model is any object with the methods below; it
is made once in each Python worker by a factory, gets bounded Arrow batches, and
its rows go on as a table. Factories must be importable on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Embedder(Protocol):
    """Vectors of images or texts, one row each."""

    dimension: int

    def embed_images(self, paths: list[str]) -> np.ndarray: ...

    def embed_text(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    """A score for each (query, candidate), higher for better."""

    def rerank(self, query: str, candidates: list[str]) -> list[float]: ...


class CaptioningModel(Protocol):
    def caption(self, paths: list[str]) -> list[str]: ...


class OcrModel(Protocol):
    def read(self, paths: list[str]) -> list[str]: ...


class AsrModel(Protocol):
    def transcribe(self, path: str) -> Iterable[tuple[float, float, str]]: ...


class ShotDetector(Protocol):
    def detect(self, path: str) -> Iterable[tuple[int, int]]: ...


class FrameExtractor(Protocol):
    def extract(self, path: str, frame_indices: list[int]) -> Iterable[str]: ...


class QueryProcessor(Protocol):
    """On the driver, once a request: see `shotline.functions.language` for the rules that need no model."""

    def process(self, query: str) -> dict: ...

    def expand_query(self, query: str) -> list[str]: ...

    def extract_temporal_events(self, query: str) -> list[str]: ...


class VectorIndex(Protocol):
    """A table of (model, frame_id, embedding): `shotline.operators.vector` searches it."""

    def search(self, queries: DataFrame, k: int) -> DataFrame: ...


class TextIndex(Protocol):
    """A table of (doc_id, source, frame_id, text): `shotline.operators.text` searches it."""

    def search(self, query: str, k: int) -> DataFrame: ...


def unit_rows(x: np.ndarray, again: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """Rows of length 1; rows that aren't finite are computed once more by `again` (their places), and fail if they still aren't."""
    x = np.asarray(x, np.float64)
    odd = np.flatnonzero(~np.isfinite(x).all(axis=1))
    if len(odd) and again is not None:
        x[odd] = again(odd)
        odd = odd[~np.isfinite(x[odd]).all(axis=1)]
    if len(odd):
        raise ValueError(f"{len(odd)} vectors aren't finite")
    return (x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)).astype(np.float32)


def _mapped(rows: DataFrame, columns: list[str], factory: Callable, apply: Callable, schema: str) -> DataFrame:
    """`apply(model, batch)` over batches of the columns, the model made once a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for batch in batches:
            yield apply(model, batch)

    return rows.select(*columns).mapInPandas(run, schema)


def embed_frames(frames: DataFrame, factory: Callable[[], Embedder], model: str) -> DataFrame:
    """(model, frame_id, embedding) of frames (frame_id, frame_path); vectors have length 1."""

    def apply(m: Embedder, b: pd.DataFrame) -> pd.DataFrame:
        paths = b.frame_path.tolist()
        x = unit_rows(m.embed_images(paths), lambda at: m.embed_images([paths[i] for i in at])) if paths else []
        return pd.DataFrame({"model": model, "frame_id": b.frame_id, "embedding": list(x)})

    return _mapped(frames, ["frame_id", "frame_path"], factory, apply, f"model string, frame_id {frames.schema['frame_id'].dataType.simpleString()}, embedding array<float>")


def embed_queries(queries: DataFrame, factory: Callable[[], Embedder], model: str) -> DataFrame:
    """(query_id, model, q) of queries (query_id, text)."""

    def apply(m: Embedder, b: pd.DataFrame) -> pd.DataFrame:
        x = unit_rows(m.embed_text(b.text.tolist())) if len(b) else []
        return pd.DataFrame({"query_id": b.query_id, "model": model, "q": list(x)})

    return _mapped(queries, ["query_id", "text"], factory, apply, f"query_id {queries.schema['query_id'].dataType.simpleString()}, model string, q array<float>")


def reranked(results: DataFrame, factory: Callable[[], Reranker]) -> DataFrame:
    """(query_id, frame_id, model_score) of results (query_id, query, frame_id, candidate): what `fusion.cross_encoder_blend` mixes in."""
    kinds = {c: results.schema[c].dataType.simpleString() for c in ("query_id", "frame_id")}

    def apply(m: Reranker, b: pd.DataFrame) -> pd.DataFrame:
        scores = pd.Series(0.0, index=b.index)
        for query, part in b.groupby("query", sort=False):
            scores[part.index] = m.rerank(query, part.candidate.tolist())
        return pd.DataFrame({"query_id": b.query_id, "frame_id": b.frame_id, "model_score": scores})

    return _mapped(results, ["query_id", "query", "frame_id", "candidate"], factory, apply, f"query_id {kinds['query_id']}, frame_id {kinds['frame_id']}, model_score double")


def described(frames: DataFrame, factory: Callable[[], CaptioningModel | OcrModel], method: str) -> DataFrame:
    """(frame_id, text) by a captioning (`caption`) or reading (`read`) model."""
    kind = frames.schema["frame_id"].dataType.simpleString()
    return _mapped(frames, ["frame_id", "frame_path"], factory, lambda m, b: pd.DataFrame({"frame_id": b.frame_id, "text": getattr(m, method)(b.frame_path.tolist())}), f"frame_id {kind}, text string")


def transcribed(videos: DataFrame, factory: Callable[[], AsrModel]) -> DataFrame:
    """(video_id, start_sec, end_sec, text): the speech of each video (video_id, path)."""
    return _expanded(videos, factory, lambda m, path: m.transcribe(path), "start_sec double, end_sec double, text string")


def detected(videos: DataFrame, factory: Callable[[], ShotDetector]) -> DataFrame:
    """(video_id, start_frame, end_frame): the shots of each video (video_id, path)."""
    return _expanded(videos, factory, lambda m, path: m.detect(path), "start_frame long, end_frame long")


def _expanded(videos: DataFrame, factory: Callable, rows: Callable, fields: str) -> DataFrame:
    names = [f.split()[0] for f in fields.split(", ")]

    def apply(m, b: pd.DataFrame) -> pd.DataFrame:
        out = [(v, *r) for v, path in zip(b.video_id, b.path, strict=True) for r in rows(m, path)]
        return pd.DataFrame(out, columns=["video_id", *names])

    return _mapped(videos, ["video_id", "path"], factory, apply, f"video_id {videos.schema['video_id'].dataType.simpleString()}, {fields}")
