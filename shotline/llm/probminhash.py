"""ProbMinHash signatures of weighted shingles.

Every shingle starts a Poisson process of its weight's rate; each arrival falls
on a random register, which keeps the element of its earliest arrival. Two
signatures agree in a register with the probability Jaccard similarity of the
weighted sets. Later arrivals only matter while they come before the latest of
the registers' minima, so a process ends there (early termination); all
processes of a batch of documents advance together.
"""

from __future__ import annotations

import numpy as np
import xxhash

from shotline.llm.bpe import Cache

SHINGLE = 5
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Arrivals drawn together when few processes are still running.
_BLOCK = 16_384


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, a bijection of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


_words = Cache(lambda w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")))


def shingles(text: str) -> np.ndarray:
    """64-bit hashes of the runs of five words, in order, repeats included.

    Words are split at white space. A text of one to four words is one shingle;
    a text without words has none.
    """
    words = text.split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - SHINGLE + 1)
    out = np.full(n, len(h) if len(h) < SHINGLE else 0, np.uint64)
    for j in range(min(SHINGLE, len(h))):
        out = mixed(out + _GOLDEN) ^ h[j : j + n]
    return mixed(out)


#: The largest weight. With all weights in 1..HEAVIEST the weighted similarity is at least the sets' divided by it.
HEAVIEST = 1.05


def weights(counts: np.ndarray) -> np.ndarray:
    """Of shingles that occur so often in their text: 1 if once, rising to HEAVIEST, so that the set decides."""
    return HEAVIEST - (HEAVIEST - 1) / counts


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """A row of 32-bit element names for each (hashes, weights) of distinct shingles; zeros for an empty set."""
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    q = np.full((len(sets), registers), none, np.uint64)
    if not sets:
        return q.astype(np.uint32)
    doc = np.repeat(np.arange(len(sets)), [len(h) for h, _ in sets])
    h = np.concatenate([h for h, _ in sets]) if len(doc) else np.empty(0, np.uint64)
    w = np.concatenate([w for _, w in sets]) if len(doc) else np.empty(0)
    name, x, t = mixed(h ^ _A) & np.uint64(0xFFFFFFFF), np.zeros(len(h)), 0
    flat = q.reshape(-1)
    while len(h):
        block = max(1, min(64, _BLOCK // len(h)))
        at = np.arange(t, t + block, dtype=np.uint64)[None, :]
        draw = mixed(h[:, None] + (at + np.uint64(1)) * _GOLDEN)
        steps = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / w[:, None]
        steps[:, 0] += x
        times = np.cumsum(steps, axis=1)
        register = (mixed(draw ^ _B) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)
        key = times.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | name[:, None]
        np.minimum.at(flat, (doc[:, None] * registers + register.astype(np.int64)).reshape(-1), key.reshape(-1))
        latest = q.max(axis=1)
        bound = np.where(latest == none, np.inf, (latest >> np.uint64(32)).astype(np.uint32).view(np.float32))
        x, t = times[:, -1], t + block
        on = x <= bound[doc]
        doc, h, w, name, x = doc[on], h[on], w[on], name[on], x[on]
    return np.where(q == none, 0, q & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def weighted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a text, ascending, and their weights."""
    h, n = np.unique(shingles(text), return_counts=True)
    return h, weights(n)


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature; keys of different bands differ."""
    n = signature.shape[1] // rows
    parts = signature.reshape(len(signature), n, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(n, dtype=np.uint64), parts.shape[:2])
    for j in range(rows):
        key = mixed(key + _GOLDEN) ^ parts[:, :, j]
    return mixed(key)


def jaccard(one: np.ndarray, other: np.ndarray) -> float:
    """Of two ascending arrays of distinct hashes; 0 if either is empty."""
    if not len(one) or not len(other):
        return 0.0
    both = len(np.intersect1d(one, other, assume_unique=True))
    return both / (len(one) + len(other) - both)
