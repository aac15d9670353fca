"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs,
schemes, plus signs, digits and cues of identifiers. Deterministic parsers then
expand each anchor to its boundaries and validate what they hold. The base kinds
(email, ip, card, phone) come out as the leftmost non-overlapping matches of
their patterns; `secret` (keys, passwords, quoted tokens), `iban` and `url` (with
user information) are added.

Null and empty texts have no span. Offsets are code points, ends exclusive.
Repeated rows are searched one by one; an empty table gives an empty result;
further columns are ignored (and kept by `redact_documents`).
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotline.llm import common

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "iban", "url")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_LABEL = _LOCAL - frozenset("._%+")
_DIGIT = frozenset("0123456789")
_DIALLED = _DIGIT | frozenset(" ().-")
_UPPER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: Cues that a value follows (after = or :), and the least length of a value.
_CUES = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey")
_VALUE = re.compile(r"\s?[=:]\s?(\"[^\"\s]{8,}\"|'[^'\s]{8,}'|[^\s\"']{8,})")
_KEY = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])")
#: What ends user information, and the characters between a cue and its value at most.
_USER_END, _SPACE = re.compile(r"[\s/@]"), re.compile(r"\s")
_VALUE_GAP = 3


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for d in _DIGIT:
        a.add_word(d, ("digit", 1))
    for word, kind in (("@", "at"), ("+", "plus"), ("://", "scheme"), ("AKIA", "key"), *((w, "cue") for c in _CUES for w in (c, c.upper(), c.capitalize()))):
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def _span(text: str, at: int, of: frozenset) -> int:
    """End of the run of such characters that begins there."""
    n = len(text)
    while at < n and text[at] in of:
        at += 1
    return at


def _emails(text: str, anchors: list[int]):
    end = 0
    for at in anchors:
        if at < end:
            continue
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        stop = _span(text, at + 1, _LABEL)
        if start == at or stop == at + 1:
            continue
        labels = 0
        while stop < len(text) and text[stop] == "." and (more := _span(text, stop + 1, _LABEL)) > stop + 1:
            stop, labels = more, labels + 1
        if labels:
            yield start, stop
            end = stop


def _runs(text: str, anchors: list[int]) -> list[tuple[int, int]]:
    """Runs of digits, from the anchors of single digits."""
    out: list[tuple[int, int]] = []
    for at in anchors:
        if out and out[-1][1] == at:
            out[-1] = (out[-1][0], at + 1)
        else:
            out.append((at, at + 1))
    return out


def _ips(text: str, runs: list[tuple[int, int]]):
    k = 0
    while k + 3 < len(runs):
        four = runs[k : k + 4]
        if all(text[a[1]] == "." and a[1] + 1 == b[0] for a, b in zip(four, four[1:], strict=False)):
            if all(len(part := text[a:b].lstrip("0")) < 4 and int(part or 0) <= 255 for a, b in four):
                yield four[0][0], four[3][1]
            k += 4
        else:
            k += 1


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def _cards(text: str, runs: list[tuple[int, int]]):
    k = 0
    while k < len(runs):
        last = k
        while last + 1 < len(runs) and runs[last + 1][0] == runs[last][1] + 1 and text[runs[last][1]] in " -":
            last += 1
        n = sum(b - a for a, b in runs[k : last + 1])
        if 13 <= n <= 19 and luhn("".join(text[a:b] for a, b in runs[k : last + 1])):
            yield runs[k][0], runs[last][1]
        k = last + 1


def _phones(text: str, anchors: list[int]):
    for at in anchors:
        if at + 3 >= len(text) or text[at + 1] not in _DIGIT:
            continue
        stop = _span(text, at + 2, _DIALLED)
        while stop > at + 3 and text[stop - 1] not in _DIGIT:
            stop -= 1
        if stop > at + 3 and 9 <= sum(c in _DIGIT for c in text[at:stop]) <= 15:
            yield at, stop


def _ibans(text: str, runs: list[tuple[int, int]]):
    end = 0
    for a, b in runs:
        start = a - 2
        if start < end or b - a < 2 or text[a - 1] not in _UPPER or text[start] not in _UPPER or start and text[start - 1].isalnum():
            continue
        stop = a
        while True:
            stop = _span(text, stop, _UPPER | _DIGIT)
            if stop + 1 < len(text) and text[stop] == " " and text[stop + 1] in _DIGIT and stop - start < 40:
                stop += 1
            else:
                break
        code = text[start:stop].replace(" ", "")
        if 15 <= len(code) <= 34 and not (stop < len(text) and text[stop].isalnum()) and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
            yield start, stop
            end = stop


def _secrets(text: str, keys: list[int], cues: list[tuple[int, int]]):
    """Keys and values behind cues, leftmost first (a key that begins a value is part of it); cues inside a span aren't searched, so the work is linear."""
    end = 0
    for at, stop in sorted([*((at, None) for at in keys), *cues], key=lambda x: x[1] or x[0]):
        if stop is None:
            m = _KEY.match(text, at) if at >= end and (not at or not text[at - 1].isalnum()) else None
            found = m.span() if m else None
        else:
            m = _VALUE.match(text, stop) if stop + _VALUE_GAP >= end else None
            found = m.span(1) if m else None
        if found and found[0] >= end:
            yield found
            end = found[1]


def _urls(text: str, anchors: list[int]):
    """scheme://user:password@ and all up to white space."""
    end = 0
    for at in anchors:
        start = at
        while start > end and text[start - 1].isascii() and text[start - 1].isalpha():
            start -= 1
        if start == at or at < end:
            continue
        stop = _USER_END.search(text, at + 3)
        if not stop or stop[0] != "@" or text.find(":", at + 4, stop.start() - 1) < 0:
            continue
        space = _SPACE.search(text, stop.end())
        last = space.start() if space else len(text)
        if last > stop.end():
            yield start, last
            end = last


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind in the order of KINDS, then by start."""
    at: dict[str, list] = {k: [] for k in ("digit", "at", "plus", "scheme", "key", "cue")}
    for last, (kind, n) in automaton().iter(text):
        at[kind].append((last + 1 - n, last + 1) if kind == "cue" else last + 1 - n)
    if not any(at.values()):
        return []
    runs = _runs(text, at["digit"])
    found = {
        "email": _emails(text, at["at"]), "ip": _ips(text, runs), "card": _cards(text, runs), "phone": _phones(text, at["plus"]),
        "secret": _secrets(text, at["key"], at["cue"]), "iban": _ibans(text, runs), "url": _urls(text, at["scheme"]),
    }
    return [(k, a, b) for k in KINDS for a, b in found[k]]


def written(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def redacted(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each span (overlapping ones as one) replaced by its kind in angle brackets."""
    out, end = [], 0
    merged: list[list] = []
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(b, merged[-1][2])
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[end:a], f"<{kind.upper()}>"]
        end = b
    return "".join([*out, text[end:]])


def find_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every text: an array of (kind, start, end)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(t)] for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    return common.over_batches(common.texts(docs), run, "doc_id long, spans array<struct<kind string, start long, end long>>")


def redact_documents(docs: DataFrame) -> DataFrame:
    """The same rows and columns with personal data replaced in ``text``; null texts stay null."""

    @F.pandas_udf("string")
    def clean(text: pd.Series) -> pd.Series:
        return text.map(lambda t: t if t is None else redacted(t, found) if (found := spans(t)) else t)

    common.bound_batches(docs.sparkSession)
    return docs.withColumn("text", clean("text"))


def digests(docs: DataFrame) -> DataFrame:
    """The query's columns, from the operator's spans."""
    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column("text").to_pylist():
            found = spans(text)
            base = [s for s in found if s[0] in BASE]
            rows.append((*(sum(s[0] == k for s in base) for k in BASE), hashlib.sha256(written(base).encode()).hexdigest(), written(found)))
        kinds = [pa.int64()] * len(BASE) + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names)

    return common.over_batches(common.texts(docs), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return digests(common.table(spark, sf_dir, "documents"))
