"""Scalar functions, validators and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotline.functions import scalar as x
from shotline.operators import evidence, quality
from shotline.plans.registry import query
from shotline.sources import fixtures as fx
from shotline.sources import store

#: Written from the rules, by DuckDB's own accent stripping.
SQZ = "trim(regexp_replace({c}, '[\\t-\\r\\x1c-\\x20\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"
PLAIN = "strip_accents(lower(replace(replace({c}, 'đ', 'd'), 'Đ', 'D')))"
WORDS = "trim(regexp_replace(" + PLAIN + ", '[^a-z0-9]+', ' ', 'g'))"
CASED = "replace(lower({c}), 'ß', 'ss')"


def _docs(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", F.col("text").alias("t"), "lang", "source")


@query(f"select doc_id, {SQZ.format(c=PLAIN.format(c='text'))} as folded from documents")
def X1_normalise(spark, sf):
    return _docs(spark, sf).select("doc_id", x.folded(F.col("t")).alias("folded"))


@query(f"select doc_id, {WORDS.format(c='text')} as words from documents")
def X2_normalise_words(spark, sf):
    return _docs(spark, sf).select("doc_id", x.folded_words(F.col("t")).alias("words"))


@query(f"with v as (select doc_id, {SQZ.format(c=CASED.format(c='text'))} as a from documents), w as (select doc_id, a, {PLAIN.format(c='a')} as b from v) select doc_id, case when a = '' then '' when a = b then a else a || '|' || b end as variants from w")
def X3_keyword_variants(spark, sf):
    return _docs(spark, sf).select("doc_id", F.array_join(x.keyword_variants(F.col("t")), "|").alias("variants"))


LEADS = "case when starts_with(w, 'the answer is ') then w[15:] when starts_with(w, 'câu trả lời là ') then w[16:] else w end"


@query(f"""with w as (select doc_id, {SQZ.format(c="regexp_replace(" + CASED.format(c="case when doc_id % 3 = 0 then 'The answer is: ' when doc_id % 3 = 1 then 'Câu trả lời là ' else '' end || text") + ", '[\\p{P}\\p{S}]', ' ', 'g')")} as w from documents) select doc_id, trim({LEADS}) as answer from w""")
def X4_answer(spark, sf):
    lead = F.when(F.col("doc_id") % 3 == 0, "The answer is: ").when(F.col("doc_id") % 3 == 1, "Câu trả lời là ").otherwise("")
    return _docs(spark, sf).select("doc_id", x.answer(F.concat(lead, "t")).alias("answer"))


@query(f"""with w as (select doc_id, list_filter(string_split({WORDS.format(c="case when doc_id % 2 = 0 then 'X là: the ' else 'A ' end || text")}, ' '), lambda t: t <> '') as w from documents),
l as (select doc_id, case when w[1:2] in (['x', 'la'], ['x', 'is'], ['answer', 'is']) then w[3:] when w[1:3] in (['dap', 'an', 'la'], ['the', 'answer', 'is']) then w[4:] when w[1:4] = ['cau', 'tra', 'loi', 'la'] then w[5:] else w end as w from w),
k as (select doc_id, w, list_position(list_transform(w, lambda t: t in ('con', 'cai', 'mot', 'a', 'an', 'the')), false) as k from l)
select doc_id, case when len(w) = 0 or k is null or k = 0 then '' else array_to_string(w[k:], ' ') end as answer from k""")
def X5_short_answer(spark, sf):
    lead = F.when(F.col("doc_id") % 2 == 0, "X là: the ").otherwise("A ")
    return _docs(spark, sf).select("doc_id", x.short_answer(F.concat(lead, "t")).alias("answer"))


@query(f"select doc_id, contains(' ' || {WORDS.format(c='text')} || ' ', ' of the ') as found from documents")
def X6_phrase(spark, sf):
    return _docs(spark, sf).select("doc_id", x.has_phrase(F.col("t"), F.lit("of the")).alias("found"))


@query("select page_id, lower(regexp_replace(string_split(trim(url), '/')[-1], '\\.[^.]*$', '')) as name from pages")
def X7_video_name(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", x.video_name(F.col("url")).alias("name"))


@query("select doc_id, pos, lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))) as line from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents)")
def X8_lines(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return d.select("doc_id", F.col("pos").cast("long").alias("pos"), F.lower(x.squeezed(F.col("line"))).alias("line"))


@query("select event_id, try_cast(s as double) as number, case when s in ('true', 'yes') then true when s in ('false', 'no') then false end as flag, greatest(0, least(1, coalesce(try_cast(s as double), 0))) as held from (select event_id, case event_id % 5 when 0 then 'true' when 1 then 'no' when 2 then '0.25' when 3 then 'x' else '7' end as s from events)")
def X9_tolerant(spark, sf):
    i = F.col("event_id") % 5
    s = F.when(i == 0, "true").when(i == 1, "no").when(i == 2, "0.25").when(i == 3, "x").otherwise("7")
    e = fx.table(spark, sf, "events").select("event_id", s.alias("s"))
    n = x.tolerant_double(F.col("s"))
    return e.select("event_id", n.alias("number"), x.tolerant_bool(F.col("s")).alias("flag"), x.clamped(F.coalesce(n, F.lit(0.0)), 0.0, 1.0).alias("held"))


@query("with i as (select event_id, event_id % 7 as a0, event_id % 7 + event_id % 5 as a1, event_id % 4 as b0, event_id % 4 + 3 as b1 from events) select event_id, round(case when greatest(a1, b1) - least(a0, b0) > 0 then greatest(0, least(a1, b1) - greatest(a0, b0)) / (greatest(a1, b1) - least(a0, b0))::double else 0 end, 6) as iou from i")
def X10_interval_iou(spark, sf):
    from shotline.operators.temporal import iou

    i = F.col("event_id")
    d = lambda c: c.cast("double")
    return fx.table(spark, sf, "events").select("event_id", F.round(iou(d(i % 7), d(i % 7 + i % 5), d(i % 4), d(i % 4 + 3)), 6).alias("iou"))


@query("select event_id, regexp_extract(props, '(?s)(\\{.*\\})', 1) as body from events")
def X12_json_body(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", x.json_body(F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).alias("body"))


@query(f"""with v as (select conv_id, turn, string_split(text, chr(10)) as v from conversations), t as (select conv_id, turn, list_filter(list_transform(v[1:20], lambda x: trim(x)), lambda x: x <> '') as v from v),
u as (select conv_id, turn, unnest(v) as value, generate_subscripts(v, 1) as pos from t), k as (select *, {WORDS.format(c='value')} as key from u),
f as (select *, row_number() over (partition by conv_id, turn, key order by pos) as n from k where key <> '')
select conv_id, turn, row_number() over (partition by conv_id, turn order by pos) - 1 as place, value from f where n = 1""")
def X13_unique(spark, sf):
    """The first twenty lines as a bounded tuple (the feature), once each."""
    values = x.unique_strings(x.string_tuple(F.split("text", "\n"), 20))
    c = fx.table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(values).alias("place", "value"))
    return c.select("conv_id", "turn", F.col("place").cast("long").alias("place"), "value")


@query("select page_id, url_encode(url) as quoted from pages")
def X14_quote(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", F.replace(F.url_encode("url"), F.lit("+"), F.lit("%20")).alias("quoted"))


@query("""with s as (select doc_id, regexp_replace(lower(text), '[^a-z0-9_-]+', '-', 'g') as s, sha256(text)[1:8] as hash from documents), t as (select doc_id, hash, regexp_replace(regexp_replace(trim(s, '-_'), '^[-_]+|[-_]+$', '', 'g'), '-{2,}', '-', 'g') as s from s)
select doc_id, case when s = '' then 'unnamed' else s end as slug, hash from t""")
def X15_slug(spark, sf):
    return _docs(spark, sf).select("doc_id", x.slug(F.col("t")).alias("slug"), F.substring(F.sha2("t", 256), 1, 8).alias("hash"))


BUDGETS = {"user": 1800, "assistant": 1300, "system": 1300}


@query("""with r as (select conv_id, role, turn, text[1:700] as t, case role when 'user' then 1800 else 1300 end as budget from conversations),
j as (select *, length(to_json(struct_pack(turn := turn, text := t))) + 3 as n, row_number() over (partition by conv_id, role order by turn) as k from r),
u as (select *, sum(n) over (partition by conv_id, role order by turn) + 2 * (k - 1) + 2 as used from j)
select conv_id, role, turn, case when used <= budget then t else t[1:greatest(80, budget // 2)] end as text from u where used <= budget or k = 1""")
def X16_budget(spark, sf):
    """Evidence rows by role, as long as their JSON list fits the role's budget; the first always stays, shortened if need be."""
    budget = F.when(F.col("role") == "user", BUDGETS["user"]).otherwise(BUDGETS["assistant"])
    return evidence.within_budget(fx.table(spark, sf, "conversations").withColumn("budget", budget), ["conv_id", "role"], "turn").select("conv_id", "role", "turn", "text")


@query(f"""with w as (select doc_id, list_filter(string_split({WORDS.format(c='text')}, ' '), lambda t: t <> '') as w from documents), k as (select doc_id, w, list_position(list_transform(w, lambda t: t in ('con', 'cai', 'mot', 'a', 'an', 'the')), false) as k from w),
l as (select doc_id, case when len(w) = 0 or k is null or k = 0 then [] else w[k:] end as w from k),
g as (select doc_id, list_filter(w, lambda t: t not in ({", ".join(f"'{t}'" for t in dict.fromkeys(x.GENERIC_LABELS))})) as w from l),
s as (select doc_id, list_sort(list_distinct(list_transform(w, lambda t: case when length(t) > 3 and t[-1] = 's' and t[-2] <> 's' then t[1:length(t) - 1] else t end))) as w from g)
select doc_id, array_to_string(w, ' ') as label, len(w) > 0 as agrees from s""")
def X17_label_tokens(spark, sf):
    """A label's identity, and whether it agrees with the same label behind an article."""
    one, other = x.label_tokens(F.col("t")), x.label_tokens(F.concat(F.lit("THE  "), "t", F.lit("!")))
    return _docs(spark, sf).select("doc_id", F.array_join(one, " ").alias("label"), x.labels_agree(one, other).alias("agrees"))


@query("with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents), k as (select *, lag(line) over (partition by doc_id order by pos) as before from l) select doc_id, string_agg(line, chr(10) order by pos) as text from k where before is null or before <> line group by all")
def P9_collapse_lines(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", x.collapse_lines(F.col("text")).alias("text"))


PATHS = """paths as (select page_id as frame_id, case when page_id % 11 = 0 then ' ' when page_id % 7 = 0 then '/runs/a/frames/' || page_id when page_id % 5 = 0 then '../b/' || page_id when page_id % 3 = 0 then 'frames\\' || page_id else 'frames/./' || page_id end as path from pages),
files as (select '/runs/a/frames/' || page_id as file from pages where length(html) % 4 <> 0)"""


def _paths(spark, sf):
    p, i = fx.table(spark, sf, "pages"), F.col("page_id")
    path = F.when(i % 11 == 0, " ").when(i % 7 == 0, F.concat(F.lit("/runs/a/frames/"), i)).when(i % 5 == 0, F.concat(F.lit("../b/"), i)).when(i % 3 == 0, F.concat(F.lit("frames\\"), i)).otherwise(F.concat(F.lit("frames/./"), i))
    return p.select(i.alias("frame_id"), path.alias("path")), p.where(F.length("html") % 4 != 0).select(F.concat(F.lit("/runs/a/frames/"), i).alias("file"))


@query(f"""with {PATHS}, n as (select frame_id, trim(path) as raw, replace(path, '\\', '/') as path from paths), a as (select *, replace(case when starts_with(path, '/') then path else '/runs/a/' || path end, '/./', '/') as full_path from n),
r as (select *, regexp_replace(full_path, '/[^/]+/\\.\\.(/|$)', '/') as resolved from a)
select frame_id, case when raw = '' then 'FRAME_PATH_MISSING' when not starts_with(resolved, '/runs/a/') then 'FRAME_PATH_OUTSIDE_EXPERIMENT' when resolved not in (select file from files) then 'FRAME_FILE_MISSING' end as reason,
  raw <> '' and starts_with(resolved, '/runs/a/') and resolved in (select file from files) and not starts_with(path, '/') as canonical from r""")
def P2_path_safety(spark, sf):
    """Missing, outside the run's folder, without a file, or not relative to it."""
    paths, files = _paths(spark, sf)
    return quality.path_states(paths, files, "/runs/a").select("frame_id", "reason", "canonical")


@query(f"with {fx.FRAMES_SQL}, h as (select vec_id * 2 as frame_id, vec_id as rank from embeddings) select h.rank, h.frame_id, f.video_id, case when f.frame_id is null then 'unknown' end as issue from h left join frames f using (frame_id)")
def P1_hydrate(spark, sf):
    """Hits with their frames; unknown ones are reported, not dropped."""
    h = fx.table(spark, sf, "embeddings").select((F.col("vec_id") * 2).alias("frame_id"), F.col("vec_id").alias("rank"))
    j = h.join(fx.frames(spark, sf).withColumn("known", F.lit(True)), "frame_id", "left")
    return j.select("rank", "frame_id", "video_id", F.when(F.col("known").isNull(), "unknown").alias("issue"))


@query(f"with {fx.DOCS_SQL} select source, count(*) as n from text_docs where source in ('ocr') group by all")
def P3_source_filter(spark, sf):
    return fx.text_docs(spark, sf).where(F.col("source").isin("ocr")).groupBy("source").agg(F.count("*").alias("n"))


@query("select vec_id as frame_id from embeddings where vec_id % 3 <> 0 and vec_id % 5 <> 0")
def P5_not_embedded(spark, sf):
    e = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_id"))
    done = e.where("frame_id % 3 = 0").union(e.where("frame_id % 5 = 0"))
    return e.join(done, "frame_id", "left_anti")


@query(f"with {fx.JOBS_SQL}, c as (select *, row_number() over (partition by item_id, stage order by step desc) as n from jobs), d as (select item_id from c where n = 1 and stage = 'EMBED' and status in ('COMPLETED', 'COMPLETED_NO_OUTPUT')) select distinct user_id as item_id from events where user_id not in (select item_id from d)")
def P6_not_completed(spark, sf):
    """Items that the EMBED stage still has to do: its completed jobs are skipped, with output or without."""
    current = store.job_states(fx.jobs(spark, sf))
    done = current.where("stage = 'EMBED'").where(F.col("status").isin("COMPLETED", "COMPLETED_NO_OUTPUT"))
    return fx.table(spark, sf, "events").select(F.col("user_id").alias("item_id")).distinct().join(done, "item_id", "left_anti")


@query(f"with {fx.FRAMES_SQL} select frame_id from frames where timestamp_sec between 10 and 30")
def P13_time_range(spark, sf):
    return fx.frames(spark, sf).where(F.col("timestamp_sec").between(10, 30)).select("frame_id")
