"""Cost-balanced packing into sequences of a fixed number of tokens.

Packing is local to a task: as its documents are encoded they gather in a group
until `GROUP_TOKENS` ids are held, then the group is packed and emitted. Nothing
is shuffled, memory is bounded by the group, and a lost task is run again alone.

In a group, whole sequences are cut from the front of longer documents; what
remains is a piece per document. The group opens as many sequences as its
remaining ids fill, the last part as sequences of falling powers of two, which
need no padding. Pieces go in descending order of estimated attention cost
(linear + quadratic in length) to the lowest-cost sequence that has room for the
whole piece; where none has, the emptiest one is filled and the cut rest goes
back among the pieces. Every sequence ends full.

Null and empty texts are the end id alone; repeated rows are packed one by one;
null doc_ids stay null; an empty table gives no piece; further columns are
ignored. Sequence ids are partition * 2^40 + a number within the partition.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from shotline.llm import common
from shotline.llm.bpe import byte_bpe

CAPACITY = 2048
END_ID = 1
#: Ids of documents that are packed together.
GROUP_TOKENS = 2 << 20
#: Cost of a piece of n ids: LINEAR * n + QUADRATIC * n^2, as a model of width 4096 has it about (12 d n + n^2 per layer and d).
LINEAR, QUADRATIC = 49_152.0, 1.0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cost(n: int | np.ndarray) -> float | np.ndarray:
    """Estimated cost of a piece that attends to itself."""
    return LINEAR * n + QUADRATIC * n * n


def capacities(tokens: int, capacity: int = CAPACITY) -> list[int]:
    """Full sequences, then the set bits of what is left."""
    full, rest = divmod(tokens, capacity)
    return [capacity] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths."""
    out, heap, sequence = [], [], 0
    for k, n in enumerate(lengths):
        for start in range(0, n - capacity + 1, capacity):
            out.append((k, start, capacity, sequence, 0))
            sequence += 1
        if rest := n % capacity:
            heap.append((-rest, k, n - rest))
    heapq.heapify(heap)
    room = np.array(capacities(-sum(x[0] for x in heap), capacity), np.int64)
    used, spent = np.zeros(len(room), np.int64), np.zeros(len(room))
    while heap:
        n, k, start = heapq.heappop(heap)
        n = -n
        fits = np.flatnonzero(room >= n)
        at = int(fits[np.argmin(spent[fits])]) if len(fits) else int(np.argmax(room))
        placed = min(n, int(room[at]))
        out.append((k, start, placed, sequence + at, int(used[at])))
        room[at] -= placed
        used[at] += placed
        spent[at] += cost(placed)
        if placed < n:
            heapq.heappush(heap, (placed - n, k, start + placed))
    return out


def pack_documents(docs: DataFrame, path: str, end_id: int = END_ID, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row for each piece of each document; see SCHEMA."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    last = np.array([end_id], "<u4").tobytes()
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, base, sequences = byte_bpe(path), TaskContext.get().partitionId() << 40, 0
        group, held = [], 0

        def packed() -> pa.RecordBatch:
            nonlocal sequences
            rows = pack([len(x) // 4 for _, x in group], capacity)
            columns = [
                [group[k][0] for k, *_ in rows], [s for _, s, *_ in rows], [n for _, _, n, *_ in rows],
                [zlib.crc32(group[k][1][4 * s : 4 * (s + n)]) for k, s, n, *_ in rows],
                [len(group[k][1]) // 4 for k, *_ in rows], [base + sequences + q for *_, q, _ in rows], [o for *_, o in rows],
            ]
            sequences += 1 + max(q for *_, q, _ in rows)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                content = bpe.encode(text) + last
                group.append((doc_id, content))
                held += len(content) // 4
                if held >= group_tokens:
                    yield packed()
                    group, held = [], 0
        if group:
            yield packed()

    return common.texts(docs).mapInArrow(run, SCHEMA)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents by the 50k byte-level vocabulary."""
    return pack_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
