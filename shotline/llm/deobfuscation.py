"""Noisy-channel restoration of disguised words.

A suspicious token is a lattice: a letter stands for itself, a digit or symbol
for the letters it imitates, a separator for nothing or for a word's end, and a
letter equal to the one before it for itself or for nothing. Each edge has a
cost under the channel; Viterbi decoding finds the path of least cost plus
surprise under a character trigram model, whose counts come from all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotline.llm import common

# Letters that digits and symbols imitate.
IMITATED = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
SEPARATORS = " .-_*'’~·"
#: Channel costs in nats: an imitated letter, a dropped separator, a word's end there, a dropped repeat (of a pair, of a longer run).
IMITATE, DROP, END, PAIR, RUN = 0.7, 0.3, 2.0, 1.5, 0.2
#: Symbols of the model: 0 for anything else, a to z, and the Latin-1 letters from U+00DF.
SYMBOLS = 60
_OUTER = ".,!?;:()[]{}\"'…|#%&*=<>/\\~^-_`«»“”‘’"
_TRAILING = re.compile(r"[$@+]{2,}$")
_TRIPLE = re.compile(r"(.)\1\1")
_DOUBLE = re.compile(r"(.)\1")
_REPEAT = re.compile(r"(.)\1+", re.DOTALL)
_PLAIN_OUTER = "".join(c for c in _OUTER if c not in IMITATED)
_SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")


def symbol(c: str) -> int:
    """Of a lower-case character."""
    if "a" <= c <= "z":
        return ord(c) - 96
    if "ß" <= c <= "ÿ":
        return ord(c) - 0xDF + 27
    return 0


_OF_CODE = np.array([symbol(chr(c)) for c in range(0x180)], np.int64)


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(trigram, n) over all texts; at most SYMBOLS^3 rows, summed in each task first."""

    def run(batches):
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            codes = np.frombuffer("  ".join(["", *batch.column("text").to_pylist(), ""]).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            s = _OF_CODE[np.where(codes < 0x180, codes, 0)]
            total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["trigram", "n"])

    common.bound_batches(docs.sparkSession)
    found = common.texts(docs).select("text").mapInArrow(run, "trigram long, n long")
    return found.groupBy("trigram").agg(F.sum("n").alias("n"))


def model(counts: DataFrame) -> np.ndarray:
    """Surprise in nats, [SYMBOLS, SYMBOLS, SYMBOLS], smoothed by the shorter contexts."""
    got = counts.toPandas()
    n = np.zeros(SYMBOLS**3)
    n[got.trigram.to_numpy(np.int64)] = got.n.to_numpy()
    three = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 0.5) / (one.sum() + 0.5 * SYMBOLS)
    p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
    p3 = (three + 5 * p2[None]) / (three.sum(2, keepdims=True) + 5)
    return -np.log(p3).astype(np.float32)


def trimmed(token: str) -> str:
    """Without punctuation around it and runs of symbols behind it."""
    return _TRAILING.sub("", token.strip(_OUTER)).strip(_OUTER)


def collapsed(word: str) -> str:
    """Each run of one character as one: the same for a word and for all its readings that only drop repeats."""
    return _REPEAT.sub(r"\1", word) if _DOUBLE.search(word) else word


def suspicious(core: str) -> bool:
    """Letters mixed with something else, or a character three times in a row."""
    if core.isalpha():
        return bool(_TRIPLE.search(core))
    return any(c.isalpha() for c in core)


def plain_letters(token: str) -> str | None:
    """A token's core if that is letters alone and its only reading, else None."""
    core = token.strip(_OUTER)
    return core if core.isalpha() and core == token.strip(_PLAIN_OUTER) else None


def readings(token: str) -> list[str]:
    """What may be disguised in a token: its core, and the same with the symbols at its edges that imitate letters.

    The core is left out if it is plain; a doubled letter may be one letter.
    """
    core, wide = trimmed(token), token.strip(_PLAIN_OUTER)
    out = [core] if core and (suspicious(core) or _DOUBLE.search(core) and core.isalpha()) else []
    return out + [wide] if wide != core and any(c.isalpha() for c in wide) else out


def spaced(text: str) -> list[str]:
    """Runs of three single characters or more, any white space apart, with one space instead."""
    return [" ".join(run.split()) for run in _SPACED.findall(text)]


def edges_of(core: str) -> Iterator[list[tuple[str, float]]]:
    """At each character of a token: what it may stand for (a letter, a space, nothing), and the channel's cost."""
    for at, c in enumerate(core):
        before = core[at - 1] if at else ""
        run = c == before and (core[at + 1 : at + 2] == c or core[at - 2 : at - 1] == c)
        edges: list[tuple[str, float]] = []
        if c in IMITATED:
            edges += [(x, IMITATE) for x in IMITATED[c]]
        if c in SEPARATORS:
            edges += [("", DROP), (" ", END)]
        elif c.isalpha():
            edges.append((c, 0.0))
        elif c not in IMITATED:
            edges.append((" ", END))
        if c == before:
            edges.append(("", RUN if run else PAIR))
        yield edges


def restore(core: str, surprise: np.ndarray) -> str:
    """The likeliest plain text of a lower-cased token; words of several are separated by spaces.

    A state is the last two symbols kept: a few at each position, so none is pruned and the decoding is exact.
    """
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for edges in edges_of(core):
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, path) in states.items():
            for x, price in edges:
                if x:
                    s = symbol(x)
                    to, total, way = (b, s), cost + price + float(surprise[a, b, s]), (x, path)
                else:
                    to, total, way = (a, b), cost + price, path
                if to not in new or total < new[to][0]:
                    new[to] = (total, way)
        states = new
    _, path = min((cost + float(surprise[a, b, 0]), k) for k, ((a, b), (cost, _)) in enumerate(states.items()))
    way, out = list(states.values())[path][1], []
    while way:
        out.append(way[0])
        way = way[1]
    return "".join(reversed(out))
