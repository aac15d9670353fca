"""Scalar functions as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_table() -> tuple[str, str]:
    """Characters of the basic plane that decompose into one character and marks, and that character."""
    marked, plain = [], []
    for code in range(0xC0, 0x10000):
        c = chr(code)
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and all(unicodedata.combining(x) for x in parts[1:]):
            marked.append(c)
            plain.append(parts[0])
    return "".join(marked), "".join(plain)


def _width_table() -> tuple[str, str]:
    """Characters whose compatibility case folding is one other character, and that one."""
    pairs = [(chr(k), unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", chr(k)).casefold())) for k in range(0xA0, 0x10000) if not 0xD800 <= k < 0xE000]
    one = [(a, b) for a, b in pairs if len(b) == 1 and b != a]
    return "".join(a for a, _ in one), "".join(b for _, b in one)


#: Accented letters and their bases; both tables follow from Unicode's data.
ACCENTED, PLAIN = _fold_table()
VARIANT, COMMON = _width_table()
#: A letter that stands for another without being composed of it.
CROSSED = (("đ", "d"), ("Đ", "D"))
#: Compatibility characters of several letters that occur in ordinary text.
LIGATURES = {"ß": "ss", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "…": "...", "ŉ": "ʼn"}
#: Letters that an analyser writes in ASCII.
ASCII = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "ı": "i", "þ": "th", "ð": "d"}
#: White space as text processing sees it: separators and the information separators.
SPACE = r"(?U)[\s\x1c-\x1f]+"
#: Function words a text analyser drops.
STOP = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with")
# Lead-ins and articles that an answer is compared without, and words that name no identity.
ANSWER_LEADS = (r"^(?:x|đáp án|câu trả lời)\s+(?:là)\s+", r"^(?:the answer|answer|x)\s+(?:is)\s+")
SHORT_LEADS = ("cau tra loi la", "dap an la", "the answer is", "answer is", "x la", "x is")
ARTICLES = ("con", "cai", "mot", "a", "an", "the")
GENERIC_LABELS = (
    "a", "an", "the", "target", "food", "ingredient", "ingredients", "object", "objects", "item", "items", "thing", "things", "piece", "pieces", "slice", "slices",
    "wedge", "wedges", "fresh", "raw", "red", "white", "nguyen", "lieu", "mon", "an", "vat", "the", "do", "con", "cai",
)


def squeezed(c: Column) -> Column:
    """White space runs as one space, none outside."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def unmarked(c: Column) -> Column:
    """Accents removed, crossed letters replaced."""
    for a, b in CROSSED:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"\p{Mn}", "")


def folded(c: Column) -> Column:
    """Lower-cased, accents removed, white space squeezed."""
    return squeezed(unmarked(F.lower(c)))


def folded_words(c: Column) -> Column:
    """The same with all but a-z and digits as spaces."""
    return F.trim(F.regexp_replace(unmarked(F.lower(c)), r"[^a-z0-9]+", " "))


def case_folded(c: Column) -> Column:
    """Compatibility forms and case folded; of characters that fold to several, those of LIGATURES."""
    for a, b in LIGATURES.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.translate(F.lower(c), VARIANT, COMMON)


def keyword_variants(c: Column) -> Column:
    """A keyword case-folded, and unaccented if that differs; empty ones have none."""
    one = squeezed(case_folded(c))
    return F.when(one == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array(one, unmarked(one))))


def answer(c: Column) -> Column:
    """An answer for comparison: compatibility and case folded, punctuation and symbols to spaces, known lead-ins dropped, accents kept."""
    out = squeezed(F.regexp_replace(case_folded(c), r"[\p{P}\p{S}]", " "))
    for lead in ANSWER_LEADS:
        out = F.regexp_replace(out, lead, "")
    return F.trim(out)


def short_answer(c: Column) -> Column:
    """Plain words of an answer without one lead-in and without leading articles."""
    led = F.regexp_replace(folded_words(c), rf"^(?:{'|'.join(SHORT_LEADS)})(?: |$)", "")
    return F.trim(F.regexp_replace(led, rf"^(?:(?:{'|'.join(ARTICLES)})(?: |$))+", ""))


def has_phrase(text: Column, phrase: Column) -> Column:
    """Whether the words of `phrase` occur in a row in `text`."""
    return F.contains(F.concat(F.lit(" "), folded_words(text), F.lit(" ")), F.concat(F.lit(" "), folded_words(phrase), F.lit(" ")))


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def video_name(c: Column) -> Column:
    """Basename, whichever way slashes lean, without its last extension, lower-cased."""
    return F.lower(F.regexp_replace(basename(F.replace(F.trim(c), F.lit("\\"), F.lit("/"))), r"\.[^.]*$", ""))


def tolerant_double(c: Column) -> Column:
    """A number, or null for anything else, NaN and infinities included."""
    v = c.try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), None).otherwise(v)


def tolerant_bool(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t.isin("true", "1", "yes", "y"), True).when(t.isin("false", "0", "no", "n"), False)


def clamped(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def slug(c: Column) -> Column:
    """Lower-case letters, digits, hyphens and underscores; "unnamed" if none is left."""
    out = F.regexp_replace(F.lower(c), r"[^a-z0-9_-]+", "-")
    out = F.regexp_replace(F.regexp_replace(out, r"^[-_]+|[-_]+$", ""), r"-{2,}", "-")
    return F.when(out == "", F.lit("unnamed")).otherwise(out)


def json_body(c: Column) -> Column:
    """The outermost {...} of a model's reply, fences dropped."""
    return F.nullif(F.regexp_extract(F.regexp_replace(c, r"```(json)?", ""), r"(?s)(\{.*\})", 1), F.lit(""))


def tokens(c: Column) -> Column:
    """Runs of letters, digits and underscores of the folded text, in ASCII where a letter has such a form, stop words dropped."""
    plain = unmarked(F.lower(c))
    for a, b in ASCII.items():
        plain = F.replace(plain, F.lit(a), F.lit(b))
    plain = F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(plain)  # nothing of it changes ASCII
    found = F.regexp_extract_all(plain, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.filter(found, lambda t: ~t.isin(*STOP))


def document_quality(text: Column, enough: int) -> Column:
    """Share of letters and digits among all but white space, less for texts with fewer than `enough`."""
    alnum = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))
    seen = F.length(F.regexp_replace(text, SPACE, ""))
    return F.when(seen > 0, alnum / seen * F.least(F.lit(1.0), alnum / F.lit(float(enough)))).otherwise(F.lit(0.0))


def collapse_lines(text: Column) -> Column:
    """Consecutive equal lines become one."""
    lines = F.split(text, "\n")
    return F.array_join(F.filter(lines, lambda x, i: (i == 0) | (x != F.get(lines, i - 1))), "\n")


def label_tokens(c: Column) -> Column:
    """The identity a label names: words of a short answer but generic ones, plurals cut (not "ss"), sorted, once each."""
    words = F.filter(F.split(short_answer(c), " "), lambda w: (w != "") & ~w.isin(*GENERIC_LABELS))
    single = lambda w: F.when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), w.substr(F.lit(1), F.length(w) - 1)).otherwise(w)
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: single(w))))


def labels_agree(one: Column, other: Column) -> Column:
    """Whether two sets of label tokens name the same identity; none if either is empty."""
    return (F.size(one) > 0) & (one == other)


def wrapped(c: Column) -> Column:
    """A value as an array; null and the empty string as an empty one."""
    return F.when(c.isNull() | (c == ""), F.array().cast("array<string>")).otherwise(F.array(c))


def string_tuple(values: Column, limit: int) -> Column:
    """The first `limit` values, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.slice(values, 1, limit), lambda v: F.trim(v)), lambda v: v != "")


def unique_strings(values: Column) -> Column:
    """A short list's values, the first of those with the same plain words; ones without words go."""
    keys = F.transform(values, lambda v: folded_words(v))
    return F.filter(values, lambda v, i: (folded_words(v) != "") & (F.array_position(keys, folded_words(v)) == i + 1))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; null if both are empty."""
    return F.when(F.size(F.array_union(a, b)) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
