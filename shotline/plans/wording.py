"""Rules over wording: routing signals, validators, event splitting, answer kinds, constraints, search texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shotline.functions import language as lang
from shotline.operators import quality
from shotline.plans.registry import query
from shotline.plans.scalars import CASED, WORDS
from shotline.sources import fixtures as fx

# The oracles state the rules anew; their word lists are fixed values and are the same.
EDGE, BACK = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
VALUES = ", ".join(f"('{m}', '{p}', {c}, {i})" for m, signals in (("ocr", lang.OCR_SIGNALS), ("asr", lang.ASR_SIGNALS)) for i, (p, c) in enumerate(signals))
CUES = {"ocr": "|".join(lang.OCR_CUES), "asr": "|".join(lang.ASR_CUES)}
#: Queries: whole texts of which every second one ends with a cue, its source quoted or not, and the language.
ASKED = (
    "asked as (select doc_id, text || case when doc_id % 2 = 0 then ' ' || (select p from signals where m = 'ocr' and i = doc_id % 27) || ' là ' "
    "|| case when doc_id % 4 = 0 then '\"' || source || '\" ' else source end || ', ' || lang when doc_id % 3 = 0 then ' ai says về ' || source || ' ; ' || lang else '' end as t from documents)"
)


def _asked(spark, sf):
    d, i = fx.table(spark, sf, "documents"), F.col("doc_id")
    signal = F.element_at(F.array(*[F.lit(p) for p, _ in lang.OCR_SIGNALS]), (i % 27 + 1).cast("int"))
    named = F.when(i % 4 == 0, F.concat(F.lit('"'), "source", F.lit('" '))).otherwise(F.col("source"))
    cue = F.when(i % 2 == 0, F.concat(F.lit(" "), signal, F.lit(" là "), named, F.lit(", "), "lang")).when(i % 3 == 0, F.concat(F.lit(" ai says về "), "source", F.lit(" ; "), "lang")).otherwise("")
    return d.select("doc_id", F.concat("text", cue).alias("t"))


@query(f"""with signals as (select * from (values {VALUES}) t(m, p, c, i)), {ASKED}, f as (select doc_id, {CASED.format(c='t')} as t from asked),
s as (select doc_id, m, max(case when contains(t, p) and regexp_matches(t, '{EDGE}' || p || '{BACK}') then c else 0 end)::double as c from f, signals group by all) select doc_id, max(c) filter (m = 'ocr') as ocr, max(c) filter (m = 'asr') as asr from s group by all""")
def X11_router_signals(spark, sf):
    return _asked(spark, sf).select("doc_id", lang.signal_confidence(F.col("t"), lang.OCR_SIGNALS).alias("ocr"), lang.signal_confidence(F.col("t"), lang.ASR_SIGNALS).alias("asr"))


def _keywords_sql(modality: str) -> str:
    cue = f"(?i){EDGE}({CUES[modality]}){BACK}"
    last = f"regexp_replace(regexp_replace(q, '{cue}', '\\1' || chr(1) || '\\3', 'g'), '{cue}', '\\1' || chr(1) || '\\3', 'g')"
    tail = "regexp_replace({v}, '(?i)\\s*(trên|tren)\\s+(màn hình|man hinh|biển|bien)\\s*$', '')" if modality == "ocr" else "{v}"
    lead = "regexp_replace(regexp_split_to_array(string_split(m, chr(1))[-1], '\\s*[,;]\\s*')[1], '(?i)^\\s*(về|ve|rằng|rang|là|la|ghi|viết|viet|hiển thị|hien thi)\\s*', '')"
    found = f"case when contains(m, chr(1)) then trim({tail.format(v=lead)}, ' ,.;:!?-') else '' end"
    quoted = "list_filter(list_transform(regexp_extract_all(q, '[\"“”]([^\"“”]+)[\"“”]', 1), lambda x: trim(x)), lambda x: x <> '')"
    first = f"when len({quoted}) > 0 then array_to_string((select list(v order by i) from (select v, min(i) as i from (select unnest({quoted}) as v, generate_subscripts({quoted}, 1) as i) group by lower(v), v) where i <= 5), '|')" if modality == "ocr" else ""
    return f"""select doc_id, case when q = '' then '' {first} when {found} <> '' then {found} when '{modality}' = 'ocr' and contains(m, chr(1)) then 'cue' else q end as keywords from (select *, {last} as m from asked_q)"""


@query(f"""with signals as (select * from (values {VALUES}) t(m, p, c, i)), {ASKED}, asked_q as (select doc_id, trim(regexp_replace(t, '\\s+', ' ', 'g')) as q from asked) {_keywords_sql('asr')}""")
def X11_keywords(spark, sf):
    """What a query asks to hear: the words behind the last cue, else the whole query."""
    return _asked(spark, sf).select("doc_id", F.array_join(lang.keywords(F.col("t"), "asr"), "|").alias("keywords"))


RUNS = """w as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') as w from documents), t as (select doc_id, unnest(w) as w, generate_subscripts(w, 1) as p from w),
eq as (select doc_id, p, g, w = lead(w, g) over (partition by doc_id, g order by p) as e from t, (values (1), (2), (3), (4)) v(g)),
isl as (select doc_id, g, count(*) as n from (select doc_id, g, p - row_number() over (partition by doc_id, g order by p) as island from eq where e) group by doc_id, g, island),
most as (select doc_id, max(n) filter (g = 1) as token, bool_or(g > 1 and n >= 3 * g) as gram from isl group by all),
c as (select doc_id, unnest(string_split(text, '')) as c, generate_subscripts(string_split(text, ''), 1) as p from documents),
ci as (select doc_id, p, c, row_number() over (partition by doc_id order by p) - row_number() over (partition by doc_id, c order by p) as island from c),
chars as (select doc_id, max(n) as n from (select doc_id, c, island, count(*) as n from ci where not regexp_matches(c, '[\\t-\\r\\x1c-\\x20\\x{85}\\p{Z}]') group by all) group by all)"""
NAMED = "array_to_string(list_filter([{}], lambda x: x is not null), ',') as issues"
META = "|".join(p.replace("'", "''") for p in lang.OCR_META)


@query(f"""with {RUNS}, d as (select *, trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') as t from documents)
select doc_id, case when t = '' then 'empty' else {NAMED.format("case when regexp_matches(t, '[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}]') then 'contains_han_cjk' end, case when length(t) > 1200 then 'too_long_chars' end, case when len(w) > 180 then 'too_long_words' end, case when regexp_matches(lower(t), '" + "|".join(lang.CAPTION_META) + "') then 'meta_or_error_phrase' end, case when chars.n >= 8 then 'repeated_character_run' end, case when token >= 5 then 'repeated_token_run' end, case when gram then 'repeated_ngram_run' end").removesuffix(' as issues')} end as issues
from d join w using (doc_id) left join most using (doc_id) left join chars using (doc_id)""")
def P7_caption_issues(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", F.array_join(quality.caption_issues(F.col("text")), ",").alias("issues"))


@query(f"""with {RUNS} select doc_id, {NAMED.format("case when regexp_matches(lower(text), '" + EDGE + "(" + META + ")" + BACK + "') then 'meta_or_error_phrase' end, case when chars.n >= 8 then 'repeated_character_run' end, case when token >= 7 then 'repeated_token_run' end, case when gram then 'repeated_ngram_run' end")}
from documents left join most using (doc_id) left join chars using (doc_id)""")
def P8_ocr_issues(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", F.array_join(quality.ocr_issues(F.col("text")), ",").alias("issues"))


@query("""select doc_id, trim(case when lang in ('en', 'fr') then source || ' ' || trim(text) else trim(text) || ' ' || source end) as composed from (select *, case when trim(text) = '' then null else text end as t from documents)""".replace("|| ' ' || trim(text) else trim(text) || ' ' ||", "|| coalesce(' ' || trim(t), '') else coalesce(trim(t) || ' ', '') ||"))
def P11_compose(spark, sf):
    """Scenes come before the question in two tracks, behind it in the others."""
    track = F.when(F.col("lang") == "en", "vqa").when(F.col("lang") == "fr", " TRAKE ").when(F.col("lang") == "de", "video_kis").otherwise("textual_kis")
    return fx.table(spark, sf, "documents").select("doc_id", lang.track_text(track, F.col("text"), F.col("source")).alias("composed"))


#: A request of many lines: the user's turns begin events, others continue them; odd conversations have context ahead.
REQUEST = "request as (select conv_id, string_agg(case when role <> 'user' or (turn = 0 and conv_id % 3 = 0) then '' when turn % 4 = 0 then 'E' || turn || ': ' when turn % 4 = 2 then 'event ' || turn || '.' else turn || '. ' end || text, chr(10) order by turn) as t from conversations group by conv_id)"


def _request(spark, sf):
    n = F.col("turn").cast("string")
    head = (
        F.when((F.col("role") != "user") | ((F.col("turn") == 0) & (F.col("conv_id") % 3 == 0)), "").when(F.col("turn") % 4 == 0, F.concat(F.lit("E"), n, F.lit(": ")))
        .when(F.col("turn") % 4 == 2, F.concat(F.lit("event "), n, F.lit("."))).otherwise(F.concat(n, F.lit(". ")))
    )
    c = fx.table(spark, sf, "conversations").select("conv_id", F.struct("turn", F.concat(head, "text").alias("t")).alias("r"))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["t"]), "\n").alias("t"))


BARE = r"regexp_replace({c}, '^[\t-\r\x1c-\x20\x{{85}}\p{{Z}}]+|[\t-\r\x1c-\x20\x{{85}}\p{{Z}}]+$', '', 'g')"


@query(f"""with {REQUEST}, l as (select conv_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as p from request), k as (select conv_id, p, {BARE.format(c='line')} as line from l),
h as (select *, regexp_matches(line, '^(?i:E\\d+|Event\\s*\\d+|\\d+)\\s*[:.]') as head from k where line <> ''), g as (select *, sum(case when head then 1 else 0 end) over (partition by conv_id order by p) as event from h),
e as (select conv_id, event, string_agg(case when head then {BARE.format(c="regexp_replace(line, '^(?i:E\\d+|Event\\s*\\d+|\\d+)\\s*[:.]\\s*', '')")} else line end, ' ' order by p) as t from g group by all),
c as (select conv_id, t as context from e where event = 0), own as (select conv_id, event, t from e where event > 0 union all select conv_id, 1, {BARE.format(c='t')} from request where conv_id not in (select conv_id from e where event > 0))
select conv_id, event - 1 as place, trim(coalesce(context || ' ', '') || own.t) as event from own left join c using (conv_id)""")
def P12_event_list(spark, sf):
    events = lang.event_list(F.col("t"), F.lit(""))
    return _request(spark, sf).select("conv_id", F.posexplode(events).alias("place", "event")).select("conv_id", F.col("place").cast("long").alias("place"), "event")


#: Descriptions: all turns joined by connectors; in every second one users' turns name an unknown X and handle it.
DESCRIBED = """described as (select conv_id, string_agg(case when turn = 0 then '' else [' sau đó ', '. Then ', ' rồi ', ', cuối cùng '][turn % 4 + 1] end || text ||
  case when role = 'user' and conv_id % 2 = 0 then [' placing 4 con X', ' đặt lên đĩa 4 con x', ' holding 2 X'][turn // 2 % 3 + 1] when role = 'user' and conv_id % 3 = 0 then ' đặt vật đó' else '' end, '' order by turn) as t,
  ['X là con gì?', 'Món ăn X có nguyên liệu nào?', 'Có bao nhiêu người?', 'Who is it, ai?', 'Màu nào?', 'Dòng chữ gì?', 'They are doing what', 'Why?'][conv_id % 8 + 1] as question from conversations group by conv_id)"""


def _described(spark, sf):
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    turn, conv = F.col("turn"), F.col("conv_id")
    ahead = F.when(turn == 0, "").otherwise(pick((" sau đó ", ". Then ", " rồi ", ", cuối cùng "), turn % 4))
    tail = F.when((F.col("role") == "user") & (conv % 2 == 0), pick((" placing 4 con X", " đặt lên đĩa 4 con x", " holding 2 X"), F.floor(turn / 2) % 3)).when((F.col("role") == "user") & (conv % 3 == 0), " đặt vật đó").otherwise("")
    c = fx.table(spark, sf, "conversations").select("conv_id", F.struct("turn", F.concat(ahead, "text", tail).alias("t")).alias("r"))
    g = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["t"]), "").alias("t"))
    questions = ("X là con gì?", "Món ăn X có nguyên liệu nào?", "Có bao nhiêu người?", "Who is it, ai?", "Màu nào?", "Dòng chữ gì?", "They are doing what", "Why?")
    return g.withColumn("question", pick(questions, conv % 8))


def _marked(text: str, pattern: str, to: str) -> str:
    """Twice, as neighbours share the character between them."""
    once = lambda t: f"regexp_replace({t}, '(?i){EDGE}({pattern}){BACK}', '\\1' || {to} || '\\3', 'g')"
    return once(once(text))


PARTS = f"""{DESCRIBED}, m as (select *, regexp_matches(t || ' ' || question, '{EDGE}[Xx]{BACK}') as unknown, {_marked('t', 'X', "'[TARGET]'")} as m from described),
n as (select *, case when unknown and not contains(m, '[TARGET]') then {_marked('m', lang.REFERRING, "'[TARGET]'")} else m end as n from m),
p as (select *, list_filter(list_transform(string_split({_marked('n', lang.CONNECTORS, 'chr(1)')}, chr(1)), lambda x: trim(x, ' ,.;:-')), lambda x: x <> '')[1:5] as p from n),
b as (select *, list_transform(p, lambda x: case when regexp_matches(x, '(?i){EDGE}({lang.HANDLING}){BACK}') or regexp_matches(x, '{EDGE}\\d+\\s+con{BACK}') then x || ' [TARGET]' else x end) as hp from p),
parts as (select conv_id, question, t, case when not unknown or contains(array_to_string(p, '|'), '[TARGET]') then p when contains(array_to_string(hp, '|'), '[TARGET]') then hp else list_concat([p[1] || ' [TARGET]'], p[2:]) end as parts from b)"""


def _parts(spark, sf):
    d = _described(spark, sf)
    return d.withColumn("parts", lang.event_parts(F.col("t"), F.concat_ws(" ", "t", "question")))


@query(f"with {PARTS} select conv_id, unnest(parts) as part, generate_subscripts(parts, 1) - 1 as pos from parts")
def X18_event_split(spark, sf):
    """At connectors, at most five parts (the feature), an unknown bound to one."""
    return _parts(spark, sf).select("conv_id", F.posexplode("parts").alias("pos", "part")).select("conv_id", F.col("pos").cast("long").alias("pos"), "part")


KIND = f"""kinds as (select conv_id, case when contains(w, 'nguyen lieu') or contains(w, 'mon an') or contains(w, 'thuc pham') then 'food' when contains(w, 'mau gi') or contains(w, 'mau nao') then 'color'
  when contains(w, 'bao nhieu') or contains(w, 'may nguoi') or contains(w, 'may con') then 'count' when contains(w, 'dong chu') or contains(w, 'chu gi') or contains(w, 'ten gi') or contains(w, 'bien so') then 'text'
  when contains(' ' || w || ' ', ' ai ') or contains(' ' || w || ' ', ' who ') then 'person' when contains(w, 'lam gi') or contains(w, 'hanh dong gi') or contains(w, 'doing what') then 'action'
  when contains(w, 'con gi') or contains(w, 'vat gi') or contains(w, 'cai gi') or contains(w, 'what is x') then 'object' else 'other' end as type from (select conv_id, {WORDS.format(c="t || ' ' || question")} as w from described))"""


@query(f"with {DESCRIBED}, {KIND} select conv_id, type from kinds")
def X19_answer_type(spark, sf):
    return _described(spark, sf).select("conv_id", lang.answer_type(F.col("t"), F.col("question")).alias("type"))


@query(f"""with {PARTS}, {KIND}, e as (select conv_id, unnest(parts) as part, generate_subscripts(parts, 1) - 1 as i from parts), r as (select conv_id, i, {WORDS.format(c='part')} as w from e where contains(part, '[TARGET]')),
c as (select conv_id, i, regexp_extract(w, '\\b([0-9]+|mot|hai|ba|bon|nam)\\s+(?:con\\s+)?target\\b', 1) as n from r), q as (select conv_id, string_agg(i::varchar, '_' order by i) as s, count(*) as n from r group by all)
select conv_id, 'TARGET_ENTITY_TYPE' as constraint_id, 'entity_type' as kind, null::int as event_index, type as value from kinds where type in ('food', 'object')
union all select conv_id, 'E' || i || '_COUNT_' || v, 'count', i, v from (select conv_id, i, case n when 'mot' then '1' when 'hai' then '2' when 'ba' then '3' when 'bon' then '4' when 'nam' then '5' else n::int::varchar end as v from c where n <> '')
union all select conv_id, 'E' || i || '_ON_PLATE', 'relation', i, 'on_plate' from r where len(list_intersect(string_split(w, ' '), ['dat', 'de', 'place', 'put'])) > 0 and len(list_intersect(string_split(w, ' '), ['dia', 'plate'])) > 0
union all select conv_id, 'E' || i || '_HELD', 'action', i, 'held' from r where len(list_intersect(string_split(w, ' '), ['cam', 'hold', 'holding'])) > 0
union all select conv_id, 'TARGET_SAME_IDENTITY_' || s, 'same_identity', null, s from q where n > 1 union all select conv_id, 'ORDER_' || s, 'order', null, s from q where n > 1""")
def X20_constraints(spark, sf):
    p = _parts(spark, sf).withColumn("c", F.explode(lang.constraint_specs(F.col("parts"), lang.answer_type(F.col("t"), F.col("question")))))
    return p.select("conv_id", "c.constraint_id", "c.kind", "c.event_index", "c.value")


SAFE_SQL = "case when type = 'food' then '{food}' when type = 'person' then '{person}' else '{object}' end"
FOCUS_EN = f"""trim(regexp_extract(c, '(?i)\\b(?:{lang.PLACING})\\s+(.+)$', 1), ' ,.;:')"""


@query(f"""with {PARTS}, {KIND}, e as (select conv_id, type, unnest(parts) as part, generate_subscripts(parts, 1) - 1 as i from parts join kinds using (conv_id)),
s as (select *, replace(part, '[TARGET]', {SAFE_SQL.format(**lang.SAFE['en'])}) as en, replace(regexp_replace(part, '(?i){EDGE}con\\s+\\[TARGET\\]', '\\1[TARGET]', 'g'), '[TARGET]', {SAFE_SQL.format(**lang.SAFE['vi'])}) as vi from e),
f as (select *, trim(trim(regexp_replace(en, '\\s+', ' ', 'g')), ' ,.;:') as c, {WORDS.format(c='vi')} as w from s), g as (select *, {FOCUS_EN} as fe,
  case when contains(w, 'dat') and contains(w, 'dia') and regexp_matches(w, '\\bdia\\b.*?\\b(1|2|3|4|5|mot|hai|ba|bon|nam)\\b\\s+(.+)$') then regexp_extract(w, '\\bdia\\b.*?\\b((1|2|3|4|5|mot|hai|ba|bon|nam)\\b\\s+.+)$', 1) || ' tren dia trang'
    when contains(w, 'cam') and regexp_matches(w, '\\b(?:cam|giu)\\b.*?\\b(1|2|3|4|5|mot|hai|ba|bon|nam)\\b\\s+(.+)$') then regexp_extract(w, '\\b(?:cam|giu)\\b.*?\\b((1|2|3|4|5|mot|hai|ba|bon|nam)\\b\\s+.+)$', 1) || ' tren tay' else '' end as fv from f),
h as (select *, case when fe <> '' and regexp_matches(c, '(?i)\\b(?:{lang.HOLDING})\\b') and not regexp_matches(fe, '(?i)\\bhands?\\b') then fe || ' in hands' else fe end as fx, contains(part, '[TARGET]') as on_target from g)
select conv_id, i as place, en || case when on_target and fx <> '' and {WORDS.format(c='fx')} <> {WORDS.format(c='en')} then '|' || fx else '' end as en,
  vi || case when on_target and fv <> '' and {WORDS.format(c='fv')} <> {WORDS.format(c='vi')} then '|' || fv else '' end as vi from h""")
def X21_search_variants(spark, sf):
    p = _parts(spark, sf).withColumn("type", lang.answer_type(F.col("t"), F.col("question"))).select("conv_id", "type", F.posexplode("parts").alias("place", "part"))
    on = F.contains("part", F.lit(lang.TARGET))
    variants = lambda which: F.array_join(lang.event_variants(F.col("part"), which, F.col("type"), on), "|").alias(which)
    return p.select("conv_id", F.col("place").cast("long").alias("place"), variants("en"), variants("vi"))


@query(f"with {fx.JOBS_SQL}, c as (select *, row_number() over (partition by item_id, stage order by step desc) as n, count(*) filter (status = 'FAILED') over (partition by item_id, stage) as attempts from jobs) select item_id, stage, status, updated_at, attempts, row_number() over (partition by stage order by updated_at, item_id) as place from c where n = 1 and status in ('FAILED', 'BLOCKED')")
def L8_failed_jobs(spark, sf):
    """Failed and blocked jobs of each stage, the longest untouched first."""
    from shotline.sources import store

    w = Window.partitionBy("stage").orderBy("updated_at", "item_id")
    out = store.failures(store.job_states(fx.jobs(spark, sf)))
    return out.select("item_id", "stage", "status", "updated_at", "attempts", F.row_number().over(w).alias("place"))
