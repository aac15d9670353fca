"""Exact cosines by tiles of queries and vectors, and what each tile reduces them to before anything is shuffled.

A tile is one partition: a share of the vectors and a block of the queries, both
dealt by the hash of their ids. Its inner products are summed over the dimensions
in turn, in doubles, so a score has the same bits wherever its vectors meet, and
copies tie. A score is null where a vector is, holds a null or has another length.

What grows with frames x queries leaves a tile only if it is the result (`pairs`,
`mean`, `ranks`); hits, maxima and weighted sums leave as a few rows of a query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vectors that one step of a sum runs over: they stay in a core's cache.
LANES = 4096
#: Query rows of a block, vector rows of a tile at most and, if the tiles suffice, at least; tiles wanted.
BLOCK, MOST, LEAST, TILES = 8192, 131072, 4096, 24
#: Queries whose approximate scores a tile holds at once.
GROUP = 16
#: Blocks wanted where a tile takes all vectors (`ranks`): each costs one more copy of them in the shuffle.
RANK_BLOCKS = 12
#: Rows of an Arrow batch that a tile returns.
ROWS = 1 << 16


def _matrices(vectors: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as a matrix) for each length; rows that are null or hold a null are in none."""
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    bad = vectors.is_null().to_numpy(zero_copy_only=False).copy()
    flat = vectors.flatten()
    starts = np.cumsum(size) - size
    if flat.null_count:
        holes = np.flatnonzero(flat.is_null().to_numpy(zero_copy_only=False))
        bad[np.searchsorted(starts + size, holes, side="right")] = True
        flat = pc.fill_null(flat, 0)
    values = flat.to_numpy(zero_copy_only=False)
    out = []
    for d in np.unique(size[~bad]):
        rows = np.flatnonzero(~bad & (size == d))
        whole = len(rows) == len(size)
        out.append((rows, values.reshape(-1, d) if whole and d else values[starts[rows][:, None] + np.arange(d)]))
    return out


def _summed(lanes: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of q with the columns of `lanes`, dimension after dimension from 0.0."""
    out, part = np.zeros(lanes.shape[1]), np.empty(lanes.shape[1])
    for row, x in zip(lanes, q, strict=True):
        np.multiply(row, x, out=part)
        np.add(out, part, out=out)
    return out


class Vectors:
    """One model's vectors in a tile, in order of their ids (null last)."""

    def __init__(self, ids: pa.Array, vectors: pa.ListArray):
        order = pc.array_sort_indices(ids, null_placement="at_end")
        self.ids, self.n = ids.take(order), len(ids)
        place = np.empty(self.n, np.int64)
        place[order.to_numpy()] = np.arange(self.n)
        self.lanes: dict[int, list] = {}
        self.whole: dict[int, bool] = {}
        for rows, matrix in _matrices(vectors):
            by_id = np.argsort(place[rows])
            rows, d = place[rows][by_id], matrix.shape[1]
            self.whole[d] = len(rows) == self.n
            self.lanes[d] = []
            for i in range(0, len(rows), LANES):
                columns = np.ascontiguousarray(matrix[by_id[i : i + LANES]].T, np.float64)
                length = np.zeros(columns.shape[1])
                for row in columns:
                    length += row * row
                self.lanes[d].append((rows[i : i + LANES], columns, np.sqrt(length) + 1e-12))

    def scores(self, q: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
        """Cosines with q, and where they aren't null (None: nowhere)."""
        out = np.zeros(self.n)
        known = q is not None and self.whole.get(len(q), False)
        valid = None if known else np.zeros(self.n, bool)
        if q is not None and len(q) in self.lanes:
            length = 0.0
            for x in q:
                length += x * x
            length = np.sqrt(length) + 1e-12
            for rows, columns, lengths in self.lanes[len(q)]:
                s = _summed(columns, q) / (lengths * length)
                if known:
                    out[rows[0] : rows[-1] + 1] = s
                else:
                    out[rows], valid[rows] = s, True
        return out, valid


class Tile:
    """models: their vectors; queries: of each query id its rows (row, model, vector or None)."""

    def __init__(self, rows: pa.Table):
        # By a filter each, columns as single arrays.
        asked, held = rows.filter(rows["asked"]), rows.filter(pc.invert(rows["asked"]))
        one = lambda t, c: t[c].combine_chunks() if t[c].num_chunks != 1 else t[c].chunk(0)
        self.models: dict[str, Vectors] = {}
        for m in sorted(x for x in pc.unique(held["model"]).to_pylist() if x is not None):
            own = held.filter(pc.equal(held["model"], m))
            self.models[m] = Vectors(one(own, "frame_id"), one(own, "vector"))
        self.asked = asked
        self.ids = one(asked, "query_id") if asked.num_rows else asked["query_id"]
        vectors: list[np.ndarray | None] = [None] * asked.num_rows
        if asked.num_rows:
            for at, matrix in _matrices(one(asked, "vector")):
                for r, q in zip(at, matrix.astype(np.float64), strict=True):
                    vectors[r] = q
        self.queries: dict[object, list] = {}
        for r, (i, m) in enumerate(zip(asked["query_id"].to_pylist(), asked["model"].to_pylist(), strict=True)):
            self.queries.setdefault(i, []).append((r, m, vectors[r]))

    def branches(self) -> Iterator[tuple[int, str, Vectors, np.ndarray, np.ndarray | None]]:
        """Of each query row with vectors: row, model, vectors, scores and where they aren't null."""
        for rows in self.queries.values():
            for r, m, q in rows:
                if m in self.models:
                    yield r, m, self.models[m], *self.models[m].scores(q)


def _first(s: np.ndarray, valid: np.ndarray | None, k: int, slack: float = 0.0) -> np.ndarray:
    """Places that hold the first k: larger first (NaN before all, null behind all), equal ones by place; more if they lie within `slack`."""
    odd = np.isnan(s)
    if valid is not None or odd.any():
        valid = np.ones(len(s), bool) if valid is None else valid
        plain = np.flatnonzero(valid & ~odd)
        return np.concatenate([np.flatnonzero(valid & odd)[:k], plain[_first(s[plain], None, k, slack)], np.flatnonzero(~valid)[:k]])
    if len(s) <= k:
        return np.arange(len(s))
    least = np.partition(s, len(s) - k)[len(s) - k]
    if not slack:
        more = np.flatnonzero(s > least)
        return np.concatenate([more, np.flatnonzero(s == least)[: k - len(more)]])
    at = np.flatnonzero(s >= least - slack)
    at = at[np.argsort(-s[at], kind="stable")]
    new = np.concatenate([[True], s[at][1:] != s[at][:-1]])  # of equal sums the first k suffice
    begun = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    return at[np.arange(len(at)) - begun < k]


def _null(values: np.ndarray, valid: np.ndarray | None) -> pa.Array:
    return pa.array(values) if valid is None else pa.array(values, mask=~valid)


def _slices(columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    batch = pa.RecordBatch.from_pydict(columns)
    for i in range(0, batch.num_rows, ROWS):
        yield batch.slice(i, ROWS)


def _pairs(tile: Tile) -> Iterator[pa.RecordBatch]:
    for r, m, v, s, valid in tile.branches():
        yield from _slices({"query_id": tile.ids.take(pa.array(np.full(v.n, r))), "model": pa.repeat(m, v.n), "frame_id": v.ids, "score": _null(s, valid)})


def _likely(v: Vectors, qs: np.ndarray, k: int) -> Iterator[np.ndarray | None]:
    """Of each of the queries the places that can be among the first k, by products in any order and a bound on their error; None: look at all."""
    lanes = v.lanes[qs.shape[1]]
    lengths = np.concatenate([x for _, _, x in lanes])
    for i in range(0, len(qs), GROUP):
        near = np.concatenate([qs[i : i + GROUP] @ columns for _, columns, _ in lanes], axis=1)
        near /= lengths * (np.sqrt((qs[i : i + GROUP] ** 2).sum(axis=1, keepdims=True)) + 1e-12)
        if not np.isfinite(near).all() or v.n <= k:
            yield from [None] * len(near)
            continue
        least = np.partition(near, v.n - k, axis=1)[:, v.n - k]
        # Sums of d products are off by d roundings of their absolute sum at most, which the lengths bound by 1.
        for row, low in zip(near, least - max(1e-12, qs.shape[1] * 1e-14), strict=True):
            yield np.flatnonzero(row >= low)


def _exact(v: Vectors, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """`Vectors.scores` of a few places."""
    out, length = np.zeros(len(at)), 0.0
    for x in q:
        length += x * x
    for j, (_, columns, lengths) in enumerate(v.lanes[len(q)]):
        own = np.flatnonzero(at // LANES == j)
        if len(own):
            here = at[own] - j * LANES
            sums = np.add.accumulate(columns[:, here] * q[:, None], axis=0)[-1] + 0.0
            out[own] = sums / (lengths[here] * (np.sqrt(length) + 1e-12))
    return out


def _hits(k: int) -> Callable[[Tile], Iterator[pa.RecordBatch]]:
    def some(v: Vectors, rows: list[tuple[int, np.ndarray | None]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]]:
        """Row, places, scores, and where those aren't null."""
        plain = {d: [x for x in rows if x[1] is not None and len(x[1]) == d] for d, whole in v.whole.items() if whole and d}
        for own in plain.values():
            for (r, q), near in zip(own, _likely(v, np.array([q for _, q in own]).reshape(len(own), -1), k) if own else [], strict=True):
                s = v.scores(q)[0] if near is None else _exact(v, q, near)
                at = _first(s, None, k)
                yield r, at if near is None else near[at], s[at], None
        for r, q in rows:
            if q is None or len(q) not in plain:
                s, valid = v.scores(q)
                at = _first(s, valid, k)
                yield r, at, s[at], None if valid is None else valid[at]

    def run(tile: Tile) -> Iterator[pa.RecordBatch]:
        for m, v in tile.models.items():
            own, found = [(r, q) for rows in tile.queries.values() for r, x, q in rows if x == m], []
            for i, one in enumerate(some(v, own), 1):
                found.append(one)
                if i % 256 == 0 or i == len(own):
                    row = np.concatenate([np.full(len(at), r) for r, at, _, _ in found])
                    known = np.concatenate([np.ones(len(at), bool) if valid is None else valid for _, at, _, valid in found])
                    at, s = np.concatenate([x[1] for x in found]), np.concatenate([x[2] for x in found])
                    yield from _slices({"query_id": tile.ids.take(pa.array(row)), "model": pa.repeat(m, len(row)), "frame_id": v.ids.take(pa.array(at)), "score": _null(s, known)})
                    found = []

    return run


def _maxima(tile: Tile) -> Iterator[pa.RecordBatch]:
    rows, models, tops = [], [], []
    for r, m, _, s, valid in tile.branches():
        s = s if valid is None else s[valid]
        rows.append(r), models.append(m), tops.append(float(s.max()) if len(s) else None)
    if rows:
        yield pa.RecordBatch.from_pydict({"query_id": tile.ids.take(pa.array(rows)), "model": pa.array(models), "top": pa.array(tops, pa.float64())})


def _fused(weights: dict[str, float] | None, models: int | None, k: int | None) -> Callable[[Tile], Iterator[pa.RecordBatch]]:
    """Sums (weights, the number of models that a frame must have) or means over a query's models of scores as shares of their maxima."""

    def run(tile: Tile) -> Iterator[pa.RecordBatch]:
        if not tile.models or not tile.queries:
            return
        every = pa.concat_arrays([v.ids for v in tile.models.values()])
        frames = pc.unique(every)
        frames = frames.take(pc.array_sort_indices(frames, null_placement="at_end"))
        slot = {m: pc.index_in(v.ids, value_set=frames).to_numpy(zero_copy_only=False) for m, v in tile.models.items()}
        same = {m: np.array_equal(at, np.arange(len(frames))) for m, at in slot.items()}
        tops = tile.asked["top"].to_pylist()
        for rows in tile.queries.values():
            lists = len({m for _, m, _ in rows})
            raw = weights is None and lists == 1
            total, n, known = np.full(len(frames), -np.inf if raw else 0.0), np.zeros(len(frames), np.int64), np.zeros(len(frames), bool)
            for r, m, q in sorted(rows, key=lambda x: x[1]):
                if m not in tile.models:
                    continue
                part, valid = tile.models[m].scores(q)
                top, at = tops[r], slot[m]
                if not raw:
                    part = part / (1.0 if top is None or top <= 1e-12 else top) * (1.0 if weights is None else weights.get(m, 1.0))
                merge = np.maximum if raw else np.add
                if same[m] and valid is None:
                    total, n, known[:] = merge(total, part), n + 1, True
                    continue
                np.add.at(n, at, 1)
                at, part = (at, part) if valid is None else (at[valid], part[valid])
                merge.at(total, at, part)
                known[at] = True
            if models is not None and (n[n > 0] != models).any():
                raise ValueError(f"models have different frames: {frames[int(np.flatnonzero((n > 0) & (n != models))[0])]}")
            total = total / lists if weights is None else total
            at = np.flatnonzero(n > 0)
            if k is not None:
                at = at[_first(total[at], None if known[at].all() else known[at], k, 2e-9)]
            yield from _slices({"query_id": tile.ids.take(pa.array(np.full(len(at), rows[0][0]))), "frame_id": frames.take(pa.array(at)), "score": _null(total[at], None if known[at].all() else known[at])})

    return run


def _order(s: np.ndarray, valid: np.ndarray | None) -> np.ndarray:
    """Places by score: NaN, larger ones, null; equal ones by place."""
    odd = np.isnan(s)
    if valid is not None or odd.any():
        kind = np.where(odd, 0, 1) if valid is None else np.where(valid, np.where(odd, 0, 1), 2)
        return np.lexsort((np.where(kind == 1, -s, 0.0), kind))
    down = -s
    at = np.argsort(down)
    t = down[at]
    return np.argsort(down, kind="stable") if (t[1:] == t[:-1]).any() else at


def _ranks(tile: Tile) -> Iterator[pa.RecordBatch]:
    for rows in tile.queries.values():
        for m in sorted({m for _, m, _ in rows if m in tile.models}):
            v, own = tile.models[m], [q for _, x, q in rows if x == m]
            found = [v.scores(q) for q in own]
            s, valid, place = *found[0], np.arange(v.n)
            if len(found) > 1:  # rows that repeat a query share its ranks
                place = np.repeat(place, len(found))
                s = np.stack([x for x, _ in found], 1).ravel()
                valid = np.stack([np.ones(v.n, bool) if y is None else y for _, y in found], 1).ravel()
            at = _order(s, valid)
            rank = np.empty(len(at), np.int32)
            rank[at] = np.arange(1, len(at) + 1, dtype=np.int32)
            yield from _slices({"query_id": tile.ids.take(pa.array(np.full(len(at), rows[0][0]))), "model": pa.repeat(m, len(at)), "frame_id": v.ids if len(found) == 1 else v.ids.take(pa.array(place)), "rank": pa.array(rank)})


def _tiled(vectors: DataFrame, queries: DataFrame, run: Callable[[Tile], Iterator[pa.RecordBatch]], out: list, size: int = BLOCK, whole: bool = False, counts: tuple[int, int] | None = None) -> DataFrame:
    """`run` over every tile. Counts queries and vectors at once, unless `counts` has them; `whole`: a tile takes all vectors, by a few blocks of queries."""
    asked, held = counts or (queries.count(), vectors.count())
    blocks = max(1, -(-asked // size))
    chunks = max(1, -(-held // MOST), min(-(-held // LEAST), -(-TILES // blocks)))
    if whole:
        blocks, chunks = max(blocks, min(RANK_BLOCKS, asked)), 1
    of = lambda n, c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = vectors.select(F.lit(False).alias("asked"), "model", "frame_id", F.col("embedding").alias("vector"), every(blocks).alias("block"), of(chunks, "frame_id").alias("chunk"))
    q = queries.select(F.lit(True).alias("asked"), "model", "query_id", F.col("q").alias("vector"), *[c for c in ("top",) if c in queries.columns], of(blocks, "query_id").alias("block"), every(chunks).alias("chunk"))
    rows = v.unionByName(q, allowMissingColumns=True).withColumn("tile", F.col("block") * chunks + F.col("chunk")).drop("block", "chunk")
    kinds = {"query_id": queries.schema["query_id"].dataType, "frame_id": vectors.schema["frame_id"].dataType, "model": T.StringType(), "rank": T.IntegerType()}
    schema = T.StructType([T.StructField(c, kinds.get(c, T.DoubleType())) for c in out])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            with np.errstate(all="ignore"):
                for batch in run(Tile(pa.Table.from_batches(held))):
                    yield batch.select(out)

    return rows.repartitionById(blocks * chunks, "tile").drop("tile").mapInArrow(over, schema)


def pairs(vectors: DataFrame, queries: DataFrame, size: int = BLOCK) -> DataFrame:
    """(query_id, model, frame_id, score) of every query and vector of a model."""
    return _tiled(vectors, queries, _pairs, ["query_id", "model", "frame_id", "score"], size)


def hits(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Of those the first k of each query and model, and others: as many from each tile."""
    return _tiled(vectors, queries, _hits(k), ["query_id", "model", "frame_id", "score"])


def ranks(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, model, frame_id, rank) of every frame by score, ties by id. A task holds all vectors in doubles, as all scores of a query must meet."""
    return _tiled(vectors, queries, _ranks, ["query_id", "model", "frame_id", "rank"], whole=True)


def _shares(vectors: DataFrame, queries: DataFrame, run: Callable[[Tile], Iterator[pa.RecordBatch]]) -> DataFrame:
    """`run` with each query's maximum in `top`. Scores are made twice instead of being shuffled."""
    counts = (queries.count(), vectors.count())
    top = _tiled(vectors, queries, _maxima, ["query_id", "model", "top"], counts=counts).groupBy("query_id", "model").agg(F.max("top").alias("top"))
    return _tiled(vectors, queries.join(top, ["query_id", "model"]), run, ["query_id", "frame_id", "score"], counts=counts)


def mean(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, frame_id, score): `fusion.weighted_sum` of all scores by model."""
    return _shares(vectors, queries, _fused(None, None, None))


def weighted(vectors: DataFrame, queries: DataFrame, weights: dict[str, float], k: int) -> DataFrame:
    """(query_id, frame_id, score): what `fusion.wsf` sums, of each tile the first k by the sum's nine digits, and others."""
    return _shares(vectors, queries, _fused(weights, len(weights), k))
