"""Rules that a model's verdicts and a judge's answers must pass.

Models' replies come as tables. Whatever they claim is checked against what was
retrieved: nothing counts without a citation that is listed and eligible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotline.functions import scalar as x

#: Least confidence of an answer.
MINIMUM = 0.65
# What names a person in an answer or as a kind.
PERSONS = ("person", "woman", "man", "human", "nguoi", "phu nu", "co gai", "nu mc")


def cited(candidates: DataFrame, claims: DataFrame, labels: DataFrame, required: list[int]) -> DataFrame:
    """(candidate_id, matched, coverage, ordered, frames) of every candidate.

    `claims` (candidate_id, event_index, label) count where `labels` (candidate_id,
    label, event_index, frame_id, ts) has the label as showing that event. Coverage
    is the share of required events matched; `ordered` whether the first times of
    required events rise strictly (events without a time are passed over).
    """
    ok = claims.select("candidate_id", "event_index", "label").distinct().join(labels, ["candidate_id", "event_index", "label"])
    per = ok.groupBy("candidate_id", "event_index").agg(F.min("ts").alias("ts"), F.collect_set("frame_id").alias("frames"))
    rows = per.groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct("event_index", "ts", "frames"))).alias("rows"))
    j = candidates.select("candidate_id").distinct().join(rows, "candidate_id", "left")
    need = F.array(*[F.lit(i) for i in required]).cast("array<int>")
    matched = F.coalesce(F.transform("rows", lambda r: r["event_index"].cast("int")), F.array().cast("array<int>"))
    times = F.transform(F.filter("rows", lambda r: r["event_index"].isin(*required) & r["ts"].isNotNull()), lambda r: r["ts"])
    rising = F.forall(F.sequence(F.lit(1), F.size(times) - 1), lambda i: F.get(times, i) > F.get(times, i - 1))
    return j.select(
        "candidate_id", matched.alias("matched"), (F.size(F.array_intersect(matched, need)) / F.lit(len(required)) if required else F.lit(1.0)).alias("coverage"),
        F.when(F.size(times) > 1, rising).otherwise(F.lit(True)).alias("ordered"),
        F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform("rows", lambda r: r["frames"])))), F.array().cast(labels.select(F.collect_list("frame_id")).schema[0].dataType)).alias("frames"),
    )


def type_conflict(answer_kind: Column, entity: Column, answer: Column) -> Column:
    """Whether a person answers a question for food or an object."""
    words = F.concat(F.lit(" "), x.folded_words(F.coalesce(answer, F.lit(""))), F.lit(" "))
    person = entity.isin(*PERSONS)
    for p in PERSONS:
        person = person | F.contains(words, F.lit(f" {p} "))
    return answer_kind.isin("food", "object") & person


def identity_consistent(labels: Column, n_required: int, canonical: Column, answer: Column) -> Column:
    """Whether all required events' observed labels, the canonical one and the answer name the same identity."""
    main = x.label_tokens(canonical)
    all_same = F.forall(labels, lambda label: x.labels_agree(main, x.label_tokens(label)))
    return (F.size(labels) >= n_required) & all_same & x.labels_agree(main, x.label_tokens(answer))


def constraints_met(candidates: DataFrame, specs: DataFrame, reported: DataFrame, observations: DataFrame) -> DataFrame:
    """(candidate_id, n_specs, met, constraint_coverage): constraints that a reply reports and that hold.

    `candidates` has (candidate_id, entity, type_conflict, ordered, coverage,
    identity, matched); `specs` (constraint_id, kind, event_index, value) are a short
    list, `reported` (candidate_id, constraint_id), `observations` (candidate_id,
    event_index, visible_count, on_plate, held). Coverage leaves entity types out.
    """
    j = candidates.crossJoin(F.broadcast(specs)).join(reported.distinct().withColumn("said", F.lit(True)), ["candidate_id", "constraint_id"], "left")
    j = j.join(observations, ["candidate_id", "event_index"], "left")
    of_kind = (F.col("entity") == F.col("value")) | ((F.col("value") == "object") & (F.col("entity") == "food"))
    holds = (
        F.when(F.col("kind") == "entity_type", of_kind & ~F.col("type_conflict"))
        .when(F.col("kind") == "order", F.col("ordered") & (F.col("coverage") >= 1))
        .when(F.col("kind") == "same_identity", F.col("identity"))
        .when(F.col("kind") == "count", F.col("visible_count") == F.col("value").cast("int"))
        .when(F.col("kind") == "relation", F.col("on_plate"))
        .when(F.col("kind") == "action", F.col("held"))
        .otherwise(F.array_contains("matched", F.col("event_index")))
    )
    j = j.withColumn("met", F.coalesce(F.col("said") & holds, F.lit(False)))
    visual = F.col("kind") != "entity_type"
    g = j.groupBy("candidate_id").agg(
        F.count("*").alias("n_specs"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("met"), F.col("constraint_id")))), ",").alias("met"),
        F.sum(visual.cast("int")).alias("n"), F.sum((visual & F.col("met")).cast("int")).alias("k"),
    )
    return g.select("candidate_id", "n_specs", "met", F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(1.0).alias("constraint_coverage"))


def verdicts(rows: DataFrame, n_required: int) -> DataFrame:
    """(candidate_id, verdict, confidence): a reply's verdict, lowered by what isn't grounded.

    `rows`: (candidate_id, verdict, answer, confidence, type_conflict, retrieved:
    share of required events the candidate has, coverage, ordered, identity,
    needs_identity, constraint_coverage, frames, contradictions: their number). A
    conflict of kinds or an event that wasn't retrieved is never supported; a missing
    answer, citation, order, identity or constraint leaves it partial.
    """
    said = F.when(F.lower("verdict").isin("supported", "partial", "not_supported"), F.lower("verdict")).otherwise(F.lit("partial"))
    uncited = (F.col("coverage") < 1) if n_required else F.lit(False)
    lacking = (
        (F.size("frames") == 0) | F.col("answer").isNull() | (F.col("answer") == "") | uncited | ~F.col("ordered") | (F.col("needs_identity") & ~F.col("identity"))
        | (F.col("constraint_coverage") < 1) | (F.col("contradictions") > 0)
    )
    verdict = F.when(F.col("type_conflict") | (F.col("retrieved") < 1), "not_supported").when((said == "supported") & lacking, "partial").otherwise(said)
    grounded = 0.5 * F.col("retrieved") + 0.3 * F.col("constraint_coverage") + 0.2 * F.col("coverage")
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.when(F.isnan("confidence"), None).otherwise(F.col("confidence")), F.lit(0.0))))
    return rows.select("candidate_id", verdict.alias("verdict"), F.least(held, grounded).alias("confidence"))


def accepted(judgements: DataFrame, required: list[int], minimum: float = MINIMUM) -> DataFrame:
    """(request, accepted, confidence): whether a judge's final answer stands.

    `judgements` has (request, status, selected_id, answer, confidence, chosen_id,
    chosen_answer, chosen_confidence, cited: (frame_id, owner, events), needs_identity,
    chosen_identity, canonical, observations: (event_index, label, chosen_label,
    frames)). It stands if it was answered as the chosen candidate's verdict has it,
    surely enough, citing frames of that candidate alone that show every required
    event, and, where one identity is asked for, names the same one everywhere.
    """
    events = F.flatten(F.transform("cited", lambda c: c["events"]))
    need = F.array(*[F.lit(i) for i in required]).cast("array<int>")
    confidence = F.least(F.col("confidence"), F.coalesce("chosen_confidence", F.lit(0.0)))
    owned = (F.size("cited") > 0) & F.forall("cited", lambda c: c["owner"] == F.col("selected_id"))
    shows = lambda frame, event: F.exists("cited", lambda c: (c["frame_id"] == frame) & (c["owner"] == F.col("selected_id")) & F.array_contains(c["events"], event))
    canonical = x.label_tokens(F.coalesce("canonical", "answer"))
    each = F.forall(
        F.filter("observations", lambda o: F.array_contains(need, o["event_index"])),
        lambda o: (F.size(o["frames"]) > 0) & x.labels_agree(x.label_tokens(o["label"]), x.label_tokens(o["chosen_label"]))
        & x.labels_agree(canonical, x.label_tokens(o["label"])) & F.forall(o["frames"], lambda f: shows(f, o["event_index"])),
    )
    observed = F.size(F.array_intersect(need, F.transform("observations", lambda o: o["event_index"]))) == len(set(required))
    same = F.col("chosen_identity") & observed & each & x.labels_agree(canonical, x.label_tokens(F.col("answer")))
    ok = (
        (F.col("status") == "answered") & (F.col("chosen_id") == F.col("selected_id")) & (F.coalesce("answer", F.lit("")) != "")
        & (x.short_answer(F.col("answer")) == x.short_answer(F.coalesce("chosen_answer", F.lit("")))) & (confidence >= minimum) & owned
        & (F.size(F.array_except(need, events)) == 0) & (~F.col("needs_identity") | same)
    )
    stands = F.coalesce(ok, F.lit(False))
    return judgements.select("request", stands.alias("accepted"), F.when(stands, confidence).otherwise(0.0).alias("confidence"))
