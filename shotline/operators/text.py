"""Full-text search: a sum of boosted BM25 clauses, and what is made of its hits.

A document's score for a request is the sum of the clauses it matches: the phrase
x8, all terms x5, at least 60 % of the terms (rounded down) x3, near terms x2.
Every clause is a BM25 sum over terms; a phrase counts as one term whose rarity is
that of its words together, a near term (within the edits its length allows) as
its request term at the rarity of all that is near it, less the further it is.

Documents are tokenised once into a small digest (lengths and the counts of the
request's own terms), which is shuffled: the counts over all documents and the
scores read the same exchange. Texts themselves don't move.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotline.functions.scalar import document_quality, folded, tokens
from shotline.operators.ranking import ranked, top_per

K1, B = 1.2, 0.75
PHRASE, ALL, MOST, FUZZY = 8.0, 5.0, 3.0, 2.0
ENOUGH = 0.6
#: Evidence rows kept of a frame.
EVIDENCE = 8


def edits(term: str) -> int:
    """Edits allowed: none up to two characters, one up to five, else two."""
    return 0 if len(term) < 3 else 1 if len(term) < 6 else 2


def _near(term: str):
    """Whether a token is within the edits that the term allows: lengths first, as they rule most tokens out."""
    k = edits(term)
    if not k:
        return lambda t: t == term
    return lambda t: F.length(t).between(len(term) - k, len(term) + k) & (F.levenshtein(t, F.lit(term), k) >= 0)


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _near_any(terms: list[str]):
    return lambda t: _any([_near(x)(t) for x in terms])


def _is(term: str):
    return lambda t: t == term


def _phrase(words: list[str], terms: list[str]) -> Column:
    """How often the words stand in `ts` one after another: places of the first word are looked at, and only if all are held."""
    if not words:
        return F.lit(0)
    if len(words) == 1:
        n = F.col("tf")[terms.index(words[0])]
        return F.when(n > 0, n).otherwise(0)
    whole = F.array(*[F.lit(w) for w in words])
    places = F.filter("ts", lambda t, i: (t == words[0]) & (F.slice("ts", i + 1, len(words)) == whole))
    return F.when(_all_of(words, terms), F.size(places)).otherwise(0)


def _expansions(term: str) -> Column:
    """(tf, boost) of each distinct token near a term; `some` has the near tokens."""
    boost = lambda t: 1 - F.levenshtein(t, F.lit(term)) / F.least(F.length(t), F.lit(len(term)))
    return F.transform(F.filter(F.array_distinct("some"), _near(term)), lambda t: F.struct(F.size(F.filter("some", lambda u: u == t)).alias("tf"), boost(t).alias("boost")))


def _digest(docs: DataFrame, requests: list[list[str]], terms: list[str], text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, dl, tf (of each term), pf (of each request's phrase), near (of each term: expansions), and `keep`, by one pass and one exchange."""
    t = docs.select("doc_id", *keep, tokens(F.col(text)).alias("ts"))
    t = t.select("doc_id", *keep, "ts", F.size("ts").alias("dl"), F.filter("ts", _near_any(terms)).alias("some"))
    t = t.withColumn("tf", F.array(*[F.size(F.filter("some", _is(x))) for x in terms]))
    phrase = [_phrase(words, terms) for words in requests]
    t = t.select("doc_id", *keep, "dl", "tf", F.array(*phrase).alias("pf"), F.array(*[_expansions(x) for x in terms]).alias("near"))
    return t.repartition(F.col("doc_id"))


def _all_of(words: list[str], terms: list[str], tf: str = "tf") -> Column:
    out = F.lit(True)
    for w in set(words):
        out = out & (F.col(tf)[terms.index(w)] > 0)
    return out


def _stats(digest: DataFrame, terms: list[str]) -> DataFrame:
    """One row: documents, mean length, and of each term the documents that hold it (df) or something near it (dfn).

    `n` adds 1 a row by way of all columns, so that the optimiser prunes none and the digest's exchange is reused.
    """
    each = lambda f: F.array(*[F.sum(f(i).cast("long")) for i in range(len(terms))])
    one = F.pmod(F.hash(*digest.columns), F.lit(1)) + 1
    df, dfn = each(lambda i: F.col("tf")[i] > 0), each(lambda i: F.size(F.col("near")[i]) > 0)
    return digest.agg(F.sum(one.cast("long")).alias("n"), F.avg("dl").alias("avg_dl"), df.alias("df"), dfn.alias("dfn"))


def _idf(df: Column) -> Column:
    return F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))


def _saturated(tf: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))


def _sum(parts: list[Column]) -> Column:
    out = F.lit(0.0)
    for p in parts:
        out = out + p
    return out


def request_terms(requests: list[str]) -> list[list[str]]:
    """Words of requests in plain letters, as the analyser has them."""
    from shotline.functions.scalar import STOP

    return [[w for w in r.lower().split() if w not in STOP] for r in requests]


def bm25(docs: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    """(doc_id, term, tf, score): BM25 parts of the terms, corpus counts over all documents."""
    d = _digest(docs, [[]], terms, text)
    j = d.crossJoin(F.broadcast(_stats(d, terms)))  # one row
    parts = F.array(*[F.struct(F.lit(t).alias("term"), F.col("tf")[i].alias("tf"), (_idf(F.col("df")[i]) * _saturated(F.col("tf")[i])).alias("score")) for i, t in enumerate(terms)])
    return j.select("doc_id", F.explode(parts).alias("p")).where("p.score > 0").select("doc_id", "p.term", "p.tf", "p.score")


def search_many(docs: DataFrame, requests: list[str], text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keyword, score) of every document that matches a clause of a request; requests are a short list.

    `keep` names small columns of `docs` that hits carry, so that they needn't be joined back.
    """
    words = request_terms(requests)
    terms = list(dict.fromkeys(w for r in words for w in r))
    if not terms:
        return docs.where(F.lit(False)).select("doc_id", *keep, F.lit("").alias("keyword"), F.lit(0.0).alias("score"))
    d = _digest(docs, words, terms, text, keep)
    j = d.crossJoin(F.broadcast(_stats(d, terms)))  # one row
    part = {t: _idf(F.col("df")[i]) * _saturated(F.col("tf")[i]) for i, t in enumerate(terms)}
    near = {
        t: _idf(F.col("dfn")[i]) * F.aggregate(F.transform(F.col("near")[i], lambda e: e["boost"] * _saturated(e["tf"])), F.lit(0.0), lambda a, x: a + x)
        for i, t in enumerate(terms)
    }
    scores = []
    for k, r in enumerate(words):
        own = list(dict.fromkeys(r))
        at = [terms.index(w) for w in own]
        exact = _sum([part[w] for w in own])
        held = sum((F.when(F.col("tf")[i] > 0, 1).otherwise(0) for i in at), F.lit(0))
        rare = _sum([_idf(F.col("df")[terms.index(w)]) for w in r])
        clauses = [
            F.when(F.col("pf")[k] > 0, PHRASE * rare * _saturated(F.col("pf")[k])).otherwise(0.0), F.when(held == len(own), ALL * exact).otherwise(0.0),
            F.when(held >= max(1, math.floor(ENOUGH * len(own))), MOST * exact).otherwise(0.0), FUZZY * _sum([near[w] for w in own]),
        ]
        if own:
            scores.append(F.struct(F.lit(requests[k]).alias("keyword"), _sum(clauses).alias("score")))
    out = j.select("doc_id", *keep, F.explode(F.array(*scores)).alias("s")).where("s.score > 0")
    return out.select("doc_id", *keep, "s.keyword", "s.score")


def search(docs: DataFrame, query: str, k: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score) of one request with the columns `keep`, all of them or the k best."""
    out = search_many(docs, [query], keep=keep).select("doc_id", *keep, "score")
    return out if k is None else out.orderBy(F.desc(F.round("score", 6)), "doc_id").limit(k)


def frame_hits(hits: DataFrame, frames: DataFrame) -> DataFrame:
    """Text hits (doc_id, frame_id, score ..) joined to their frame; those without one go."""
    return hits.where("frame_id is not null").join(frames, "frame_id")


def speech_hits(hits: DataFrame, mapped: DataFrame, k: int) -> DataFrame:
    """Score x temporal weight of each mapped frame, the best per frame, top k."""
    j = hits.join(mapped, "doc_id").withColumn("s", F.col("score") * F.col("weight"))
    best = ranked(j, ["frame_id"], [F.desc(F.round("s", 9)), "doc_id"], "n").where("n = 1")
    out = best.select("frame_id", "video_id", "doc_id", F.col("s").alias("score"))
    return top_per(out.orderBy(F.desc(F.round("score", 9)), "frame_id").limit(k).withColumn("one", F.lit(1)), ["one"], [F.desc(F.round("score", 9)), "frame_id"], k).drop("one")


def keyword_hits(docs: DataFrame, requests: list[tuple[str, tuple[str, ...], tuple[str, ...]]], pool: int) -> DataFrame:
    """(request, keyword, doc_id, frame_id, source, score, quality, weight, exact_phrase) of requests (name, keywords, sources).

    Each keyword takes its `pool` best documents of the request's sources; a
    document that has no frame, or no quality, has no hit.
    """
    spark = docs.sparkSession
    words = list(dict.fromkeys(k for _, ks, _ in requests for k in ks))
    asked = spark.createDataFrame([(n, k, s) for n, ks, ss in requests for k in ks for s in ss], "request string, keyword string, source string")
    h = search_many(docs, words, keep=("frame_id", "source")).join(F.broadcast(asked), ["keyword", "source"])  # the requests themselves
    best = top_per(h, ["request", "keyword"], [F.desc(F.round("score", 6)), "doc_id"], pool).drop("rank")
    # `pool` documents a keyword meet their texts: a bounded side, so that texts aren't shuffled.
    out = docs.select("doc_id", "text").join(F.broadcast(best), "doc_id").where("frame_id is not null")
    out = out.withColumn("quality", quality(F.col("source"), F.col("text"))).withColumn("exact_phrase", F.contains(folded(F.col("text")), folded(F.col("keyword"))))
    return out.where("quality > 0").withColumn("weight", F.lit(1.0)).drop("text")


def keyword_evidence(hits: DataFrame, k: int, by: tuple[str, ...] = ("request",)) -> DataFrame:
    """Frames of a request: the best of normalised score x quality x weight over keywords, raised by 0.2 for each further keyword; the top k.

    Scores are spread over 0..1 among the hits of a request's keyword (equal ones: 1).
    """
    w = Window.partitionBy(*by, "keyword")
    low, span = F.min("score").over(w), F.max("score").over(w) - F.min("score").over(w)
    normal = F.when(span <= 1e-9, 1.0).otherwise((F.col("score") - low) / span)
    h = hits.withColumn("c", normal * F.col("quality") * F.col("weight")).withColumn("semantic", folded(F.col("keyword")))
    g = h.groupBy(*by, "frame_id").agg(F.max("c").alias("best"), F.countDistinct("semantic").alias("n_keywords"), F.avg("quality").alias("avg_quality"))
    out = g.withColumn("score", F.col("best") * (1 + 0.2 * (F.col("n_keywords") - 1)))
    return top_per(out, list(by), [F.desc(F.round("score", 9)), F.asc("frame_id")], k).drop("best")


def evidence_rows(hits: DataFrame, by: tuple[str, ...] = ("request",), most: int = EVIDENCE) -> DataFrame:
    """At most `most` hits of each frame as its evidence, by keyword and score."""
    return ranked(hits, [*by, "frame_id"], ["keyword", F.desc(F.round("score", 6)), "doc_id"], "n").where(F.col("n") <= most).drop("n")


def suppress_near(hits: DataFrame, window: float = 2.0) -> DataFrame:
    """Of hits with the same (keyword, video_id, shot_id, norm) those within `window` s of one kept before go, in rank order."""
    g = hits.groupBy("keyword", "video_id", "shot_id", "norm").agg(F.array_sort(F.collect_list(F.struct("rank", "ts", "doc_id"))).alias("h"))
    kept = F.expr(f"aggregate(h, slice(h, 1, 0), (a, x) -> if(exists(a, y -> abs(y.ts - x.ts) <= {window}), a, concat(a, array(x))))")
    return g.select("keyword", "video_id", "shot_id", F.explode(kept).alias("x")).select("keyword", "video_id", "shot_id", F.col("x.doc_id").alias("doc_id"), F.col("x.rank").alias("rank"))


def hit_quality(hits: DataFrame, results: DataFrame, keywords: DataFrame, by: list) -> DataFrame:
    """Of each request: keyword coverage, score separation and document quality of its first ten results, mixed .5/.3/.2.

    `keywords` has (by, keyword) asked for; keywords that differ in accents or case
    only are one. Separation is (best - median of ten) / best; a single result is
    fully apart, none isn't at all.
    """
    asked = keywords.select(*by, folded(F.col("keyword")).alias("k")).distinct().groupBy(*by).agg(F.count("*").alias("asked"))
    met = hits.select(*by, folded(F.col("keyword")).alias("k")).distinct().groupBy(*by).agg(F.count("*").alias("met"))
    top = results.where("rank <= 10").groupBy(*by).agg(F.max("score").alias("best"), F.expr("percentile(score, 0.5)").alias("median"), F.count("*").alias("n"), F.avg("avg_quality").alias("quality"))
    j = asked.join(met, by, "left").join(top, by, "left")
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("best") - F.col("median")) / F.greatest(F.abs(F.col("best")), F.lit(1e-9))))
    j = j.withColumn("coverage", F.coalesce(F.col("met"), F.lit(0)) / F.col("asked")).withColumn("separation", F.when(F.col("n").isNull(), 0.0).when(F.col("n") == 1, 1.0).otherwise(held))
    j = j.withColumn("quality", F.coalesce("quality", F.lit(0.0)))
    return j.select(*by, "coverage", "separation", "quality", (0.5 * F.col("coverage") + 0.3 * F.col("separation") + 0.2 * F.col("quality")).alias("hit_quality"))


def joint_request(ocr: tuple[str, ...], asr: tuple[str, ...], confidence: dict[str, float]) -> tuple[tuple[str, ...], float] | None:
    """One list of keywords for both sources (the first of those that fold to the same), and the larger confidence; none without either."""
    import unicodedata

    seen: dict[str, str] = {}
    for word in (*ocr, *asr):
        word = word.strip()
        key = " ".join(unicodedata.normalize("NFKC", word).casefold().split())
        if key:
            seen.setdefault(key, word)
    most = max(confidence.get("ocr", 0.0), confidence.get("asr", 0.0))
    return (tuple(seen.values()), most) if seen and most > 0 else None


def quality(source: Column, text: Column) -> Column:
    """Document quality: six characters are enough on screen, twelve in speech."""
    return F.when(source == "ocr", document_quality(text, 6)).otherwise(document_quality(text, 12))
