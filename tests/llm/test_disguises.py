"""Disguises at a token's edges, doubled letters and spaced words reach the decoder."""

from __future__ import annotations

import random

import pytest

from shotline.llm import deobfuscation, toxicity
from shotline.llm.bpe import Cache


@pytest.fixture(scope="module")
def surprise(spark):
    d = spark.createDataFrame([(1, "you idiot stupid mess fat idiot " * 200)], "doc_id long, text string")
    return deobfuscation.model(deobfuscation.trigram_counts(d))


@pytest.mark.parametrize(
    "text, word",
    [("you !diot", "idiot"), ("you |diot", "idiot"), ("a me$$", "mess"), ("so stuupid", "stupid"), ("f a t", "fat"), ("i  d  i  o  t", "idiot"), ("i\td\ti\to\tt", "idiot")],
)
def test_words_end_to_end(surprise, text, word):
    assert word in toxicity.words(text, surprise, Cache(lambda t: toxicity.plain(t, surprise)))


def test_plain_words_stay(surprise):
    assert {"hello", "mess"} <= toxicity.words("hello! (mess)", surprise, Cache(lambda t: toxicity.plain(t, surprise)))


def test_words_that_cannot_hold_evidence_hold_none(surprise):
    """The shortcut before decoding never drops an evidence."""
    random.seed(3)
    known = {e: 1 for w in ("idiot", "stupid", "mess", "fat", "aab", "o", "see") for e in toxicity.evidence(w)}
    short, lengths = toxicity.collapsed_evidence(known)
    n = 0
    for _ in range(30_000):
        base = random.choice(["idiot", "stupid", "mess", "fat", "aab", "o", "see", "house", "id", "mes"])
        letters = "".join(c * random.choice([1, 1, 1, 2, 3]) for c in base) + random.choice(["", "s", "ss", "ing"])
        assert deobfuscation.plain_letters(letters) == letters
        if toxicity.holds_nothing(letters, short, lengths):
            n += 1
            assert not toxicity.held_by(set(toxicity.plain(letters, surprise)), known), letters
    assert n > 1000
    assert deobfuscation.plain_letters("idiot!") is None and deobfuscation.plain_letters("'idiot',") == "idiot"
