"""Validators and integrity reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotline.functions.scalar import SPACE
from shotline.functions.language import CAPTION_META, OCR_META, OUTER_SPACE, bounded
from shotline.operators.fusion import aligned

SEVERITY = {"READY": 0, "DEGRADED": 1, "INVALID": 2}
#: Eight equal characters in a row, white space apart from none.
LINE_END = r"\r\n|[\n\r\x0B\f\x1c-\x1e\x85\u2028\u2029]"
CHARACTER_RUN = r"(?U)(\S)\1{7}"


def _joined(text: Column) -> Column:
    """The lower-cased words of a text, one space apart."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), " ")


def token_run(words: Column, n: int) -> Column:
    """Whether a word (of words one space apart) occurs n times in a row."""
    return words.rlike(rf"(?:^| )(\S++)(?: \1(?= |$)){{{n - 1}}}")


def ngram_run(words: Column, times: int = 4) -> Column:
    """Whether two to four words occur `times` in a row."""
    return F.lit(False) | words.rlike("|".join(rf"(?:^| )((?:\S++ ){{{g - 1}}}\S++)(?: \{k}(?= |$)){{{times - 1}}}" for k, g in enumerate((2, 3, 4), 1)))


def _reasons(*rules: tuple[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))


def caption_issues(text: Column) -> Column:
    """All rules that a caption breaks, in order; null and blank ones are "empty" alone."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), OUTER_SPACE, "")
    words = _joined(bare)
    found = _reasons(
        ("contains_han_cjk", bare.rlike(r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]")),
        ("too_long_chars", F.length(bare) > 1200),
        ("too_long_words", F.size(F.split(words, " ")) > 180),
        ("meta_or_error_phrase", F.lower(bare).rlike("|".join(CAPTION_META))),
        ("repeated_character_run", bare.rlike(CHARACTER_RUN)),
        ("repeated_token_run", token_run(words, 6)),
        ("repeated_ngram_run", ngram_run(words)),
    )
    return F.when(bare == "", F.array(F.lit("empty"))).otherwise(found)


def ocr_issues(text: Column) -> Column:
    """All rules that on-screen text breaks, in order: blank text is valid, any script and length too, words may repeat more."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), OUTER_SPACE, "")
    words = _joined(bare)
    return _reasons(
        ("meta_or_error_phrase", F.lower(bare).rlike(bounded("|".join(OCR_META)))),
        ("repeated_character_run", bare.rlike(CHARACTER_RUN)),
        ("repeated_token_run", token_run(words, 8)),
        ("repeated_ngram_run", ngram_run(words)),
    )


#: Common lines that are looked up in place; more of them are joined.
MOST_COMMON = 10_000


def drop_common_lines(docs: DataFrame, ratio: float = 0.5, least: int = 2, most: int = MOST_COMMON) -> DataFrame:
    """(doc_id, text): lines that occur (folded, once a document) in max(least, int(n * ratio)) of the n documents go, blank ones too.

    Documents without a line left go; if no line is common, all texts stay as they
    are. One shuffle of lines combined on the map side finds the common ones: n *
    ratio documents hold each, so they number as many as a document's lines /
    ratio. They are counted, looked up in place up to `most`, joined beyond.
    """
    normed = lambda line: F.lower(F.trim(F.regexp_replace(line, SPACE, " ")))
    lines = F.filter(F.split("text", LINE_END), lambda line: normed(line) != "")
    d = docs.select("doc_id", "text", lines.alias("lines"))
    norms = d.select(F.explode(F.array_distinct(F.transform("lines", normed))).alias("norm"))
    n = docs.agg(F.greatest(F.lit(least), F.floor(F.count("*") * ratio)).alias("limit"))
    common = norms.groupBy("norm").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).where("df >= limit").select("norm")  # n is one row
    found = [r.norm for r in common.limit(most + 1).collect()]
    if not found:
        return docs.select("doc_id", "text")
    if len(found) <= most:
        kept = d.select("doc_id", F.filter("lines", lambda line: ~normed(line).isin(found)).alias("kept")).where(F.size("kept") > 0)
        return kept.select("doc_id", F.array_join("kept", "\n").alias("text"))
    rows = d.select("doc_id", F.posexplode("lines").alias("pos", "line")).withColumn("norm", normed(F.col("line"))).join(common, "norm", "left_anti")
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x.line), "\n").alias("text"))


def issues(m: dict[str, DataFrame], dims: int) -> DataFrame:
    """(code, severity, item): faults within and between an experiment's manifests.

    `m` has videos (video_id, checksum, size_bytes), files (the same, as found),
    shots (shot_id, video_id, start_frame, end_frame), frames (frame_id, video_id,
    shot_id), vectors (frame_id, embedding), docs (doc_id, source, frame_id,
    video_id), captions (frame_id), paths (see `path_states`) and jobs (see
    `store.job_states`). Repeated rows of a manifest are one issue of the key.
    """
    videos, shots, frames, vectors = m["videos"], m["shots"], m["frames"], m["vectors"]
    say = lambda df, code, item, severity="ERROR": df.select(F.lit(code).alias("code") if isinstance(code, str) else code.alias("code"), F.lit(severity).alias("severity"), F.col(item).cast("long").alias("item"))
    twice = lambda df, key: df.groupBy(key).count().where("count > 1")
    lacks = lambda df, other, key: df.join(other.select(key).distinct(), key, "left_anti")
    found = m["files"].select("video_id", F.col("checksum").alias("sum_found"), F.col("size_bytes").alias("size_found"))
    stored = videos.join(found, "video_id")
    one = frames.distinct()
    owned = one.join(shots.select("shot_id", F.col("video_id").alias("shot_video")).distinct(), "shot_id")
    path = F.coalesce("reason", F.lit("FRAME_PATH_NOT_CANONICAL"))
    odd = F.exists("embedding", lambda v: F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return reduce(
        DataFrame.unionByName,
        [
            say(lacks(videos, m["files"], "video_id"), "MISSING_VIDEO_FILE", "video_id", "WARNING"), say(stored.where("size_bytes <> size_found"), "VIDEO_SIZE_MISMATCH", "video_id"),
            say(stored.where("size_bytes = size_found and checksum <> sum_found"), "VIDEO_CHECKSUM_MISMATCH", "video_id"), say(twice(videos, "video_id"), "DUPLICATE_VIDEO", "video_id"),
            say(twice(shots, "shot_id"), "DUPLICATE_SHOT", "shot_id"), say(lacks(shots, videos, "video_id"), "UNKNOWN_SHOT_VIDEO", "shot_id"), say(shots.where("end_frame < start_frame"), "INVALID_SHOT_BOUNDARY", "shot_id"),
            say(twice(frames, "frame_id"), "DUPLICATE_FRAME", "frame_id"), say(lacks(one, videos, "video_id"), "UNKNOWN_FRAME_VIDEO", "frame_id"), say(lacks(one, shots, "shot_id"), "UNKNOWN_FRAME_SHOT", "frame_id"),
            say(owned.where("shot_video <> video_id"), "FRAME_SHOT_VIDEO_MISMATCH", "frame_id"), say(m["paths"].where("reason is not null or not canonical"), path, "frame_id"),
            say(vectors.where(F.size("embedding") != dims), "EMBEDDING_DIMENSION_INVALID", "frame_id"), say(vectors.where(odd), "EMBEDDING_NON_FINITE", "frame_id"), say(twice(vectors, "frame_id"), "EMBEDDING_DUPLICATE_FRAME_ID", "frame_id"),
            say(lacks(vectors, frames, "frame_id"), "EMBEDDING_UNKNOWN_FRAME", "frame_id"), say(lacks(frames.select("frame_id").distinct(), vectors, "frame_id"), "EMBEDDING_COVERAGE_INCOMPLETE", "frame_id"),
            say(twice(m["docs"], "doc_id"), "DUPLICATE_DOCUMENT", "doc_id"), say(lacks(m["docs"].where("source = 'ocr'"), frames, "frame_id"), "OCR_UNKNOWN_FRAME", "doc_id"), say(lacks(m["docs"].where("source = 'asr'"), videos, "video_id"), "ASR_UNKNOWN_VIDEO", "doc_id"),
            say(twice(m["captions"], "frame_id"), "DUPLICATE_CAPTION", "frame_id"), say(lacks(m["captions"], frames, "frame_id"), "CAPTION_UNKNOWN_FRAME", "frame_id"), say(m["jobs"].where("status in ('FAILED', 'BLOCKED')"), "JOB_NOT_COMPLETED", "item_id"),
        ],
    )


def readiness(found: DataFrame, by: list | tuple = ()) -> DataFrame:
    """READY without issues, DEGRADED with warnings, INVALID with errors; one row, or one for each group that has issues."""
    level = F.coalesce(F.max(F.when(F.col("severity") == "ERROR", 2).otherwise(1)), F.lit(0)).alias("level")
    g = found.groupBy(*by).agg(level, F.count("*").alias("n_issues"))
    return g.select(*by, F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), F.col("level") + 1).alias("status"), "n_issues")


def embedding_report(vectors: DataFrame, frames: DataFrame, dims: int) -> DataFrame:
    """One row: dims, n, n_frames, n_not_finite, n_unknown, n_missing, coverage of the known frames, and status."""
    known = frames.select("frame_id").distinct()
    fine = F.forall("embedding", lambda v: ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    v = vectors.select("frame_id", F.size("embedding").alias("d"), fine.alias("fine")).join(known.withColumn("known", F.lit(True)), "frame_id", "left")
    a = v.agg(
        F.max("d").cast("long").alias("dims"), F.bool_and(F.col("d") == dims).alias("shaped"), F.count("*").alias("n"), F.countDistinct("frame_id").alias("n_frames"), F.sum((~F.col("fine")).cast("long")).alias("n_not_finite"),
        F.countDistinct(F.when(F.col("known").isNull(), F.col("frame_id"))).alias("n_unknown"), F.countDistinct(F.when(F.col("known"), F.col("frame_id"))).alias("covered"),
    )
    j = a.crossJoin(F.broadcast(known.agg(F.count("*").alias("all"))))  # one row each
    ready = F.col("shaped") & (F.col("n") == F.col("n_frames")) & (F.col("n_not_finite") == 0) & (F.col("n_unknown") == 0) & (F.col("covered") == F.col("all"))
    return j.select("dims", "n", "n_frames", "n_not_finite", "n_unknown", (F.col("all") - F.col("covered")).alias("n_missing"), (F.col("covered") / F.col("all")).alias("coverage"), F.when(ready, "READY").otherwise("INVALID").alias("status"))


def staleness(now: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """(key, stale): whether a checksum differs from the stored one, or none is stored."""
    j = now.join(stored.select(key, F.col("checksum").alias("was")), key, "left")
    return j.select(key, (~F.col("checksum").eqNullSafe(F.col("was"))).alias("stale"))


def coverage(frames: DataFrame, docs: DataFrame) -> DataFrame:
    """Per source: documents, frames covered, share of all frames."""
    n = frames.agg(F.countDistinct("frame_id").alias("n_frames"))
    known = docs.join(frames.select("frame_id").distinct(), "frame_id", "left_semi")
    per = docs.groupBy("source").agg(F.count("*").alias("n_docs")).join(known.groupBy("source").agg(F.countDistinct("frame_id").alias("n_covered")), "source", "left")
    return per.crossJoin(F.broadcast(n)).select("source", "n_docs", F.coalesce("n_covered", F.lit(0)).alias("n_covered"), (F.coalesce("n_covered", F.lit(0)) / F.col("n_frames")).alias("share"))


def alignment(vectors: DataFrame) -> DataFrame:
    """Per model: frames that others have and it lacks, and whether it has all of them."""
    lack = aligned(vectors.select("model", "frame_id")).groupBy("model").agg(F.count("*").alias("n_missing"))
    models = vectors.select("model").distinct()
    return models.join(lack, "model", "left").select("model", F.coalesce("n_missing", F.lit(0)).alias("n_missing"))


def provenance_changes(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field) whose values differ, nulls equal to nulls."""
    j = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"))
    diff = F.array(*[F.when(~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), F.lit(f)) for f in fields])
    return j.select(F.col(f"o.{key}").alias(key), F.explode(F.filter(diff, lambda x: x.isNotNull())).alias("field"))


def path_states(paths: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """(frame_id, resolved, reason, canonical): frame paths against a run's folder and its files (file: absolute).

    Relative paths start at `root`, slashes may lean either way, "." and one ".." a
    path are resolved. `canonical`: valid and relative.
    """
    raw = F.coalesce("path", F.lit(""))
    slashed = F.replace(raw, F.lit("\\"), F.lit("/"))
    full = F.when(slashed.startswith("/"), slashed).otherwise(F.concat(F.lit(f"{root}/"), slashed))
    resolved = F.regexp_replace(F.replace(full, F.lit("/./"), F.lit("/")), r"/[^/]+/\.\.(?=/|$)", "")
    p = paths.withColumn("resolved", F.when(F.trim(raw) != "", resolved)).join(files.select(F.col("file").alias("resolved")).distinct().withColumn("there", F.lit(True)), "resolved", "left")
    reason = (
        F.when(F.col("resolved").isNull(), "FRAME_PATH_MISSING").when(~F.col("resolved").startswith(f"{root}/"), "FRAME_PATH_OUTSIDE_EXPERIMENT")
        .when(F.col("there").isNull(), "FRAME_FILE_MISSING")
    )
    return p.select("frame_id", "path", "resolved", reason.alias("reason"), (reason.isNull() & ~slashed.startswith("/")).alias("canonical"))


def path_migration(states: DataFrame, root: str) -> DataFrame:
    """(frame_id, path, new_path, changed, issue, may_apply): paths relative to the run's folder.

    A record without a file inside the folder is an issue; with any of them the plan must not be applied (and readiness
    is void once one is).
    """
    raw = F.replace(F.coalesce("path", F.lit("")), F.lit("\\"), F.lit("/"))
    new = F.when(F.col("reason").isNull(), F.substring("resolved", len(root) + 2, 1 << 30))
    p = states.withColumn("new_path", new).withColumn("issue", F.col("reason").isNotNull())
    n = p.agg((F.sum(F.col("issue").cast("long")) == 0).alias("may_apply"))  # one row
    return p.crossJoin(F.broadcast(n)).select("frame_id", "path", "new_path", F.coalesce(new != raw, F.lit(False)).alias("changed"), "issue", F.coalesce("may_apply", F.lit(True)).alias("may_apply"))
