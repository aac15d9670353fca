"""Encoders that give the ids of the tokenizers library, cached by chunk.

Texts are cut where a pre-token surely ends (before a single space or newline
between other characters); each chunk's ids are kept in a bounded cache of the
Python worker. Chunks that are a run of Latin letters with at most a run of
plain punctuation behind go through the rank-ordered merge of the same
vocabulary; all other chunks and texts go to the library itself.
"""

from __future__ import annotations

import json
import re
import weakref
from functools import lru_cache
from itertools import islice

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from shotline.llm.common import cpu_threads_off

#: Entries of all of a worker's caches together; beyond that they are emptied and fill again.
CACHE_ENTRIES = 200_000
#: Chunks longer than this many characters aren't kept.
LONGEST_KEPT = 64
#: Latin letters in one pre-token class, and punctuation that forms runs of its own.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
_SIMPLE = re.compile(f"([{_LETTERS}]+)([.,!?;:#$%&*|]*)")
#: White space but single spaces and newlines, as any of the engines sees it; isprintable() is false for all of it.
_ODD_SPACE = re.compile("[^\\S \\n]|\u180e")
_BEYOND_LATIN = re.compile(r"[^\x00-ſ]")


def byte_symbols() -> dict[int, str]:
    """Byte -> printable character of byte-level vocabularies: itself if visible, else from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)}


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class Cache(dict):
    """Chunk -> value, made by `make` on a miss; bounded by itself and together with the process's other caches.

    A worker process serves one stage after another: what an earlier stage has
    cached goes as soon as a later one needs the room.
    """

    held = 0
    others: weakref.WeakSet = weakref.WeakSet()

    def __init__(self, make, entries: int = CACHE_ENTRIES):
        self.make, self.entries = make, entries
        self.others.add(self)

    __hash__ = object.__hash__

    def __eq__(self, other):
        return self is other

    def __missing__(self, chunk: str):
        value = self.make(chunk)
        if len(chunk) <= LONGEST_KEPT:
            if len(self) >= self.entries or Cache.held >= CACHE_ENTRIES:
                for cache in list(self.others) if Cache.held >= CACHE_ENTRIES else [self]:
                    cache.clear()
                Cache.held = sum(map(len, list(self.others)))
            self[chunk] = value
            Cache.held += 1
        return value


class ByteBpe:
    """A byte-level vocabulary whose pre-tokens keep their leading space."""

    def __init__(self, path: str):
        cpu_threads_off()
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path) as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.added_as_written = not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")) and not spec["normalizer"]
        back = {c: b for b, c in byte_symbols().items()}
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        self.size = max([*self.bytes_of, *(t["id"] for t in spec["added_tokens"])]) + 1
        pieces = {b: i for i, b in self.bytes_of.items()}
        self.piece = tiktoken.Encoding("vocabulary", pat_str=r"(?s).+", mergeable_ranks=pieces, special_tokens={})._core_bpe.encode_single_piece
        for t in spec["added_tokens"]:
            self.bytes_of[t["id"]] = t["content"].encode()
        self.newline = self.ids("\n")
        self.later = Cache(lambda w: packed(self.later_chunk(w)))

    def ids(self, text: str) -> list[int]:
        """As the library has them."""
        return self.library.encode(text, add_special_tokens=False).ids

    def chunk(self, chunk: str) -> list[int]:
        """Ids of one chunk that holds no added token."""
        word = chunk[1:] if chunk[:1] == " " else chunk
        if m := _SIMPLE.fullmatch(word):
            letters, rest = m.groups()
            out = self.piece((chunk[: len(chunk) - len(word)] + letters).encode())
            return out + self.piece(rest.encode()) if rest else out
        return self.ids(chunk)

    def chunks(self, text: str) -> list[str] | None:
        """The text cut before single spaces and newlines, without the spaces.

        None if other white space, doubled or outer white space or an added
        token occurs: such texts go to the library whole.
        """
        if any(t in text for t in self.added):
            return None
        if not text.replace("\n", "").isprintable() and _ODD_SPACE.search(text):
            return None
        found = text.replace("\n", " \n").split(" ")
        return None if "" in found or "\n" in found else found

    def later_chunk(self, word: str) -> list[int]:
        """Ids of a chunk after the first: a line's first word keeps its newline, others get their space back."""
        if word[0] == "\n":
            return [*self.newline, *self.chunk(word[1:])]
        return self.chunk(" " + word)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        found = self.chunks(text)
        if found is None:
            return packed(self.ids(text))
        return packed(self.chunk(found[0])) + b"".join(map(self.later.__getitem__, islice(found, 1, None)))


class WordBpe:
    """A lower-casing vocabulary with word ends that drops white space."""

    def __init__(self, path: str):
        cpu_threads_off()
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path) as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec["added_tokens"]]
        back = {c: b for b, c in byte_symbols().items()}
        end = spec["model"]["end_of_word_suffix"]
        # A zero byte stands for the word's end; texts with one go to the library.
        pieces = {bytes(back[c] for c in s.removesuffix(end)) + b"\0" * s.endswith(end): i for s, i in spec["model"]["vocab"].items() if s not in self.added}
        self.piece = tiktoken.Encoding("vocabulary", pat_str=r"(?s).+", mergeable_ranks=pieces, special_tokens={})._core_bpe.encode_single_piece
        self.words = Cache(lambda w: packed(self.chunk(w)))
        self.raw = Cache(lambda w: packed(self.ids(w)), CACHE_ENTRIES // 4)

    def ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def chunk(self, word: str) -> list[int]:
        """Ids of a lower-cased word of Latin characters."""
        if m := _SIMPLE.fullmatch(word):
            letters, rest = m.groups()
            out = self.piece(letters.encode() + b"\0")
            return out + self.piece(rest.encode() + b"\0") if rest else out
        return self.ids(word)

    def encode(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return packed(self.ids(text))
        if _BEYOND_LATIN.search(text):
            return b"".join(map(self.raw.__getitem__, text.replace("\n", " ").split(" ")))
        return b"".join(map(self.words.__getitem__, text.lower().replace("\n", " ").split(" ")))


@lru_cache(4)
def byte_bpe(path: str) -> ByteBpe:
    """One for each worker process and vocabulary."""
    return ByteBpe(path)


@lru_cache(4)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)
