"""Quality rules: a threshold table compiled into one Spark projection.

All figures come from built-in expressions, without user functions: a narrow
pass that never shuffles. A word is a run of characters other than space and
U+0009 to U+000D. Windows of eight words are compared by 64-bit hashes of their
word hashes (two different windows of one text agree with odds of some 10^-12
for a text of a thousand words).

Null texts have no words; empty and short texts fail the base rule; an empty
table gives an empty result; repeated rows are judged one by one; further columns
are ignored (and kept by `keep_documents`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotline.llm import common

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
WINDOW = 8
# Frequent function words of the corpus's four languages.
STOP_WORDS = {
    "en": "the be to of and that have with in is it for on was as are this by",
    "fr": "de la le et les des un une en du que est pour dans qui au sur pas",
    "de": "der die und in den von zu das mit sich für des auf ist im nicht ein",
    "es": "de la que el en y los se del las por un con una no para su al",
}


@dataclass(frozen=True)
class Rule:
    """`figure` (a Spark SQL expression over the counts) lies between the bounds; null figures pass."""

    name: str
    figure: str
    least: float | None = None
    most: float | None = None

    def holds(self) -> Column:
        x, both = F.expr(self.figure), F.lit(True)
        if self.least is not None:
            both = both & (x >= self.least)
        if self.most is not None:
            both = both & (x <= self.most)
        return F.coalesce(both, F.lit(True))


BASE = (
    Rule("words", "n_words", least=20),
    Rule("repeated_words", "100 * n_repeat_words - 30 * n_words", most=0),
)
RULES = (
    Rule("words_at_most", "n_words", most=10_000_000),
    Rule("mean_word_length", "word_chars / nullif(n_words, 0)", least=2.0, most=12.0),
    Rule("symbol_ratio", "n_symbols / nullif(n_words, 0)", most=0.1),
    Rule("stop_word_ratio", "n_stop_words / nullif(n_words, 0)", least=0.02),
    Rule("duplicate_line_ratio", "n_dup_lines / nullif(n_lines, 0)", most=0.5),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _stop_hashes() -> str:
    return ", ".join(f"xxhash64('{w}')" for w in sorted({w for ws in STOP_WORDS.values() for w in ws.split()}))


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with the figures that rules are made of, in columns of their own names, and `_seen`.

    `_seen` is always true but not deterministic: rules that refer to it can't be
    pushed below the figures, where each use would compute the arrays anew.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    # Each step's arrays are used more than once by the next, so that the optimiser doesn't inline them into a lambda.
    df = docs.select(*kept, F.array_remove(F.split(t, SPACE), "").alias("_words"), F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)).alias("_lines"))
    df = df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    df = df.withColumn("_windows", F.expr(f"case when size(_hashes) >= {WINDOW} then transform(sequence(1, size(_hashes) - {WINDOW - 1}), i -> xxhash64(slice(_hashes, i, {WINDOW}))) end"))
    # Sorted (hash, place) only where a window occurs twice.
    df = df.withColumn("_sorted", F.expr("case when size(array_distinct(_windows)) < size(_windows) then sort_array(transform(_windows, (h, i) -> struct(h as h, i as i))) end"))
    df = df.withColumn(
        "_places",
        F.expr("""case when size(_sorted) > 1 then sort_array(transform(filter(sequence(0, size(_sorted) - 1),
            k -> (k > 0 and _sorted[k].h = _sorted[greatest(k - 1, 0)].h) or (k < size(_sorted) - 1 and _sorted[k].h = _sorted[least(k + 1, size(_sorted) - 1)].h)),
            k -> _sorted[k].i)) end"""),
    )
    repeated = F.expr(f"coalesce(aggregate(_places, struct(0L as n, 0 as stop), (a, p) -> struct(a.n + (p + {WINDOW} - greatest(p, a.stop)) as n, p + {WINDOW} as stop), a -> a.n), 0L)")
    out = {
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_stop_words": F.expr(f"size(filter(_hashes, h -> h in ({_stop_hashes()})))").cast("long"),
        "n_repeat_words": repeated,
        "_seen": F.monotonically_increasing_id() >= 0,
    }
    return df.select(*kept, *(x.alias(n) for n, x in out.items()))


def compiled(rules: tuple[Rule, ...]) -> Column:
    """All rules as one expression over `counted`."""
    held = F.col("_seen")
    for rule in rules:
        held = held & rule.holds()
    return held


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, counts, base_failed, kept) of every text."""
    df = counted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    base = compiled(BASE)
    return df.select("doc_id", *COUNTS, (~base).alias("base_failed"), (base & compiled(rules)).alias("kept"))


def keep_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that pass, with their own columns."""
    one = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text"))
    return counted(one).where(compiled(BASE) & compiled(rules)).select("_row.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules over all documents."""
    return judge(common.table(spark, sf_dir, "documents"))


OP8_SQL = f"""
with t as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '{WORD}+') as ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) as ls from t),
win as (select rid, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') as k from w, unnest(range(1, len(ws) - {WINDOW - 2})) as u(i)),
dup as (select rid, i from (select rid, i, count(*) over (partition by rid, k) as c from win) where c > 1),
rep as (select rid, sum(least({WINDOW}, coalesce(after - i, {WINDOW}))) as n from (select rid, i, lead(i) over (partition by rid order by i) as after from dup) group by rid),
f as (select w.doc_id, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
  cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols, cast(len(ls) as bigint) as n_lines, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
  cast(coalesce(rep.n, 0) as bigint) as n_repeat_words,
  cast(len(list_filter(ws, lambda x: list_contains([{', '.join(repr(x) for x in sorted({x for ws in STOP_WORDS.values() for x in ws.split()}))}], x))) as bigint) as n_stop_words
  from w left join rep using (rid)),
g as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and word_chars between 2.0 * n_words and 12.0 * n_words and n_symbols <= 0.1 * n_words and n_stop_words >= 0.02 * n_words
  and n_words <= 10000000 and n_dup_lines <= 0.5 * n_lines as kept
from g
"""
