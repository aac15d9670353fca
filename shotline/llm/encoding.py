"""Byte-pair encoding and decoding, with tree concatenation of long unsplit text.

Ordinary chunks come from the worker's cache of `bpe`. A text that holds a run of
more than `UNSPLIT` bytes which pre-tokenisation doesn't split is encoded by a
tree: the run is halved until a part has `LEAF` bytes at most, all parts are
encoded in parallel (by `THREADS` threads of the worker where there are many),
then the halves are joined level by level, each level's joins in parallel too. At
a join, a window of `WINDOW` ids on either side is encoded anew; it grows until
its first id equals the left side's and its last id the right side's (or the side
is used up). A sequence of ids is the merge-rank encoding of its bytes exactly if
each two neighbours are, so from there on both sides stand as they are and the
join is exact. Added tokens inside such a text stand for themselves, as in the
library; what lies between them is encoded piece by piece.

Nulls and empty texts have no ids and decode to the empty text; repeated rows are
encoded one by one; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from shotline.llm import common
from shotline.llm.bpe import ByteBpe, byte_bpe, byte_symbols, packed

#: Bytes of a pre-token from which it is encoded by a tree, and of a leaf.
UNSPLIT = 1024
LEAF = 256
#: Ids on either side of a join at first.
WINDOW = 4
#: Threads of a worker for one batch, and parts of a batch from which they are used.
THREADS, MANY = 4, 64


class Tree:
    """Tree concatenation by a byte-level vocabulary's own merges."""

    def __init__(self, bpe: ByteBpe):
        self.bpe = bpe
        self.bare = Tokenizer(bpe.library.model)  # no normaliser, no pre-tokeniser: the merges alone
        self.symbols = byte_symbols()
        self.long = re.compile(r"\S{%d}|\s{%d}" % (UNSPLIT // 4, UNSPLIT // 4))
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(bpe.added, key=len, reverse=True))) + ")") if bpe.added else None
        if not bpe.added_as_written:
            raise ValueError("added tokens that take white space or words around them aren't supported")
        self.id_of = {t: bpe.library.token_to_id(t) for t in bpe.added}

    def _batch(self, parts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.bare.encode_batch(parts, add_special_tokens=False)]

    def merged(self, parts: list[str]) -> list[list[int]]:
        """Each part's ids by the merges; the library lets go of the interpreter, so threads run at the same time."""
        if len(parts) < MANY:
            return self._batch(parts)
        with ThreadPoolExecutor(THREADS) as pool:
            shares = pool.map(self._batch, (parts[k * len(parts) // THREADS : (k + 1) * len(parts) // THREADS] for k in range(THREADS)))
            return [ids for share in shares for ids in share]

    def string(self, ids: list[int]) -> str:
        return "".join(self.symbols[b] for i in ids for b in self.bpe.bytes_of[i])

    def joined(self, pairs: list[tuple[list[int], list[int]]]) -> list[list[int]]:
        """The ids of each pair's concatenated bytes."""
        out: list[list[int]] = [[]] * len(pairs)
        open_ = {k: WINDOW for k in range(len(pairs))}
        while open_:
            at = list(open_)
            windows = self.merged([self.string(pairs[k][0][-open_[k] :] + pairs[k][1][: open_[k]]) for k in at])
            for k, window in zip(at, windows, strict=True):
                (left, right), n = pairs[k], open_[k]
                if (n >= len(left) or window[0] == left[-n]) and (n >= len(right) or window[-1] == right[n - 1]):
                    out[k] = left[: max(0, len(left) - n)] + window + right[n:]
                    del open_[k]
                else:
                    open_[k] = 2 * n
        return out

    def unsplit(self, symbols: str) -> list[int]:
        """The ids of one pre-token, given as byte symbols."""
        n = 1
        while n * LEAF < len(symbols):
            n *= 2
        cuts = [len(symbols) * k // n for k in range(n + 1)]
        level = self.merged([symbols[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
        while len(level) > 1:
            level = self.joined(list(zip(level[::2], level[1::2], strict=True)))
        return level[0]

    def encode(self, text: str) -> bytes:
        """The library's ids as little-endian unsigned 32-bit integers."""
        if not self.long.search(text):
            return self.bpe.encode(text)
        out = []
        for k, piece in enumerate(self.added.split(text) if self.added else [text]):
            if k % 2:
                out.append(self.id_of[piece])
                continue
            for symbols, _ in self.bpe.library.pre_tokenizer.pre_tokenize_str(piece) if piece else ():
                out += self.unsplit(symbols) if len(symbols) > UNSPLIT else self.merged([symbols])[0]
        return packed(out)


class Decoder:
    """Ids to text, bytes that aren't UTF-8 replaced as the library does."""

    def __init__(self, bpe: ByteBpe):
        self.pieces = [bpe.bytes_of.get(i, b"") for i in range(bpe.size)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(2)
def tree(path: str) -> Tree:
    return Tree(byte_bpe(path))


@lru_cache(2)
def decoder(path: str) -> Decoder:
    return Decoder(byte_bpe(path))


@lru_cache(2)
def numerals(path: str) -> list[str]:
    """Decimal string of each id."""
    return [str(i) for i in range(byte_bpe(path).size)]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [np.frombuffer(tree(path).encode(t), "<u4").astype(np.int32) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return common.over_batches(common.texts(docs), run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids: empty."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [decoder(path).decode(ids or []) for ids in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return common.over_batches(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded, then decoded from the ids, in one narrow pass."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode, decode, numeral = tree(path).encode, decoder(path).decode, numerals(path).__getitem__
        rows = []
        for text in batch.column("text").to_pylist():
            ids = np.frombuffer(encode(text), "<u4").tolist()
            rows.append((len(ids), hashlib.sha256(",".join(map(numeral, ids)).encode()).hexdigest(), hashlib.sha256(decode(ids).encode()).hexdigest()))
        n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return common.over_batches(common.texts(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents by the 50k byte-level vocabulary, and decode the ids."""
    return round_trip(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
