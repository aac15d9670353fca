"""A file of token ids: independent zstandard frames and a trailing seek table.

One frame for each document, with zstandard's own content checksum. Behind the
frames lie two skippable frames that any zstandard reader passes over: an index
(partition, segment, doc ids; magic 0x184D2A50) and the seek table of the public
seekable format (magic 0x184D2A5E; compressed size, content size and low 32 bits
of XXH64 for each frame; frame count, flags, magic 0x8F92EAB1 at the very end).
A reader takes the table from the file's end and decompresses wanted frames only.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
import zstandard

INDEX_MAGIC, TABLE_MAGIC, END_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
END = struct.pack("<I", END_MAGIC)
#: Stands for a null id in the index.
NULL_ID = -(1 << 63)
_FOOTER = 9


class Corrupt(ValueError):
    """A checksum, size or magic number that doesn't hold."""


def compressor(level: int = 3) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)


def checksum(content: bytes) -> int:
    return xxhash.xxh64_intdigest(content) & 0xFFFFFFFF


def segment(partition: int, number: int, doc_ids: list[int], frames: list[bytes], sizes: list[int], sums: list[int]) -> bytes:
    """The bytes of one file."""
    index = struct.pack("<qqq", partition, number, len(doc_ids)) + np.array(doc_ids, "<i8").tobytes()
    table = np.array([[len(f) for f in frames], sizes, sums], "<u4").T.tobytes() + struct.pack("<IB", len(frames), 0x80) + END
    return b"".join([*frames, struct.pack("<II", INDEX_MAGIC, len(index)), index, struct.pack("<II", TABLE_MAGIC, len(table)), table])


class Segment:
    """A reader over a file's bytes (or a buffer that maps them)."""

    def __init__(self, data: bytes):
        self.data = data
        end = len(data)
        if end < _FOOTER or data[end - 4 : end] != END:
            raise Corrupt("no seek table at the end")
        n, flags = struct.unpack("<IB", data[end - _FOOTER : end - 4])
        if flags != 0x80:
            raise Corrupt("unknown flags")
        at = end - _FOOTER - 12 * n - 8
        if at < 0 or struct.unpack("<II", data[at : at + 8]) != (TABLE_MAGIC, 12 * n + _FOOTER):
            raise Corrupt("seek table doesn't fit")
        table = np.frombuffer(data[at + 8 : at + 8 + 12 * n], "<u4").reshape(n, 3).astype(np.int64)
        self.sizes, self.sums = table[:, 1], table[:, 2]
        self.offsets = np.concatenate([[0], np.cumsum(table[:, 0])])
        start = int(self.offsets[-1])
        magic, length = struct.unpack("<II", data[start : start + 8])
        if magic != INDEX_MAGIC or start + 8 + length != at:
            raise Corrupt("index doesn't fit")
        self.partition, self.number, count = struct.unpack("<qqq", data[start + 8 : start + 32])
        self.doc_ids = np.frombuffer(data[start + 32 : at], "<i8")
        if count != n or len(self.doc_ids) != n:
            raise Corrupt("index and seek table differ")
        self._unzip = zstandard.ZstdDecompressor()

    def content(self, k: int) -> bytes:
        """Frame k alone, checked."""
        try:
            out = self._unzip.decompress(self.data[int(self.offsets[k]) : int(self.offsets[k + 1])])
        except zstandard.ZstdError as e:
            raise Corrupt(str(e)) from e
        if len(out) != self.sizes[k] or checksum(out) != self.sums[k]:
            raise Corrupt(f"frame {k} doesn't match the seek table")
        return out

    def read(self, doc_ids: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        """Ids of the requested documents; frames of others stay compressed."""
        wanted = np.fromiter(doc_ids, np.int64)
        for k in np.flatnonzero(np.isin(self.doc_ids, wanted)):
            yield int(self.doc_ids[k]), np.frombuffer(self.content(k), "<u4")
