"""Rules over the wording of queries, questions and events, as column expressions.

Texts are read whole. Word limits are those of letters, digits and underscores in
any script.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shotline.functions import scalar as x

BEFORE, BEHIND = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
TARGET = "[TARGET]"
OUTER_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"

# Phrases that hint at on-screen text or speech, and how surely.
OCR_SIGNALS = (
    ("dòng chữ", 0.95), ("dong chu", 0.95), ("biển hiệu", 0.95), ("bien hieu", 0.95), ("bảng hiệu", 0.95), ("bang hieu", 0.95), ("phụ đề", 0.9), ("phu de", 0.9),
    ("số điện thoại", 0.95), ("so dien thoai", 0.95), ("biển số", 0.95), ("bien so", 0.95), ("mã qr", 0.95), ("ma qr", 0.95), ("trên màn hình", 0.85),
    ("tren man hinh", 0.85), ("văn bản", 0.85), ("van ban", 0.85), ("quảng cáo", 0.8), ("quang cao", 0.8), ("nhãn hiệu", 0.85), ("nhan hieu", 0.85), ("logo", 0.9),
    ("chữ", 0.85), ("chu", 0.85), ("text", 0.8), ("sign", 0.8),
)
ASR_SIGNALS = (
    ("phát biểu", 0.95), ("phat bieu", 0.95), ("lời thoại", 0.95), ("loi thoai", 0.95), ("nghe thấy", 0.95), ("nghe thay", 0.95), ("giọng nói", 0.9),
    ("giong noi", 0.9), ("đề cập", 0.9), ("de cap", 0.9), ("thảo luận", 0.9), ("thao luan", 0.9), ("phỏng vấn", 0.9), ("phong van", 0.9), ("nói về", 0.95),
    ("noi ve", 0.95), ("nói", 0.85), ("noi", 0.85), ("spoken", 0.85), ("speech", 0.85), ("says", 0.85),
)
# Cues that keywords follow, and what is dropped around them.
OCR_CUES = (
    "dòng chữ", "dong chu", "biển hiệu", "bien hieu", "bảng hiệu", "bang hieu", "phụ đề", "phu de", "số điện thoại", "so dien thoai", "biển số", "bien so", "mã qr",
    "ma qr", "logo", "chữ", "chu", "text", "sign", "quảng cáo", "quang cao", "nhãn hiệu", "nhan hieu",
)
ASR_CUES = (
    "phát biểu", "phat bieu", "lời thoại", "loi thoai", "nghe thấy", "nghe thay", "giọng nói", "giong noi", "đề cập", "de cap", "thảo luận", "thao luan",
    "phỏng vấn", "phong van", "nói về", "noi ve", "nói", "noi", "spoken", "speech", "says",
)
CUE_LEAD = r"(?iu)^\s*(?:về|ve|rằng|rang|là|la|ghi|viết|viet|hiển thị|hien thi)\s*"
OCR_TAIL = r"(?iu)\s*(?:trên|tren)\s+(?:màn hình|man hinh|biển|bien)\s*$"
SEARCH_LEAD = r"(?iu)^\s*(?:hãy\s+|hay\s+)?(?:tìm kiếm|tim kiem|tìm|tim|cho tôi xem|cho toi xem)\s+"
# Temporal connectors, phrases that refer to an unknown target, and words of direct handling.
CONNECTORS = r"sau\s+đó|sau\s+vài\s+giây|tiếp\s+theo|kế\s+tiếp|cuối\s+cùng|rồi|then|next|finally"
REFERRING = r"con\s+vật|vật\s+thể|đối\s+tượng|con\s+đó|vật\s+đó|thứ\s+đó"
HANDLING = r"đặt|cầm|giơ|nâng|lấy|bỏ|xếp|cho|put|hold|place|pick"
MOST_EVENTS = 5
# Phrases of validators, in any place and between word limits.
CAPTION_META = (
    "lỗi hệ thống", "xu ly sai", "xử lý sai", "sửa lại", "sua lai", "đoạn trên", "doan tren", "tôi xin sửa", "toi xin sua", "xin lỗi", "xin loi", "output trước", "output truoc",
)
OCR_META = ("as an ai", "i'm sorry", "i am sorry", "i cannot", "i can't")
# Questions by the first kind whose phrase they hold (plain words; "ai" and "who" as words).
ANSWER_KINDS = (
    ("food", ("nguyen lieu", "mon an", "thuc pham")), ("color", ("mau gi", "mau nao")), ("count", ("bao nhieu", "may nguoi", "may con")),
    ("text", ("dong chu", "chu gi", "ten gi", "bien so")), ("person", (r"\b(?:ai|who)\b",)), ("action", ("lam gi", "hanh dong gi", "doing what")),
    ("object", ("con gi", "vat gi", "cai gi", "what is x")),
)
NUMBERS = {"mot": 1, "hai": 2, "ba": 3, "bon": 4, "nam": 5}
# What stands for a target of a kind in a search text.
SAFE = {"en": {"food": "food ingredients", "object": "object", "person": "person"}, "vi": {"food": "nguyên liệu món ăn", "object": "vật thể", "person": "người"}}
SAFE_DEFAULT = {"en": "object", "vi": "vật thể"}
HOLDING = r"holding|holds|hold|lifting|picking\s+up"
PLACING = rf"placing|putting|places|puts|{HOLDING}"


def bounded(phrases: str) -> str:
    """A pattern of whole words."""
    return f"{BEFORE}(?:{phrases}){BEHIND}"


def signal_confidence(text: Column, signals: tuple) -> Column:
    """The highest confidence of a phrase in the text, 0 without one: one pattern for each level, highest first."""
    t, out = x.case_folded(text), F.lit(0.0)
    for level in sorted({c for _, c in signals}):
        out = F.when(t.rlike(bounded("|".join(p for p, c in signals if c == level))), F.lit(level)).otherwise(out)
    return out


def stripped(c: Column, chars: str = " ,.;:!?-") -> Column:
    return F.btrim(c, F.lit(chars))


def keywords(text: Column, modality: str) -> Column:
    """What a query asks to read or hear: quoted strings (at most five), else the words behind its last cue, else the query without its lead-in."""
    q = x.squeezed(text)
    quoted = F.filter(F.transform(F.regexp_extract_all(q, F.lit("[\"“”]([^\"“”]+)[\"“”]"), F.lit(1)), lambda v: F.trim(v)), lambda v: v != "")
    cue = "(?iu)" + bounded("|".join(OCR_CUES if modality == "ocr" else ASR_CUES))
    matched = F.coalesce(F.try_element_at(F.regexp_extract_all(q, F.lit(f"({cue})"), F.lit(1)), F.lit(-1)), F.lit(""))
    behind = F.element_at(F.split(q, cue), -1)
    value = F.regexp_replace(F.element_at(F.split(behind, r"\s*[,;]\s*", 2), 1), CUE_LEAD, "")
    value = stripped(F.regexp_replace(value, OCR_TAIL, "") if modality == "ocr" else value)
    lead = F.trim(F.regexp_replace(q, SEARCH_LEAD, ""))
    one = F.when((matched != "") & (value != ""), F.array(value))
    if modality == "ocr":
        distinct = F.filter(quoted, lambda v, i: F.array_position(F.transform(quoted, lambda w: F.lower(w)), F.lower(v)) == i + 1)
        one = F.when(F.size(quoted) > 0, F.slice(distinct, 1, 5)).otherwise(one)
        one = F.coalesce(one, F.when(matched != "", F.array(matched)))
    return F.when(q == "", F.array().cast("array<string>")).otherwise(F.coalesce(one, F.array(F.when(lead != "", lead).otherwise(q))))


def answer_type(query: Column, question: Column) -> Column:
    """The kind of answer asked for, by the first rule that fits."""
    q, out = x.folded_words(F.concat_ws(" ", query, question)), F.lit("other")
    for kind, phrases in reversed(ANSWER_KINDS):
        out = F.when(q.rlike("|".join(phrases)), F.lit(kind)).otherwise(out)
    return out


def event_parts(text: Column, source: Column) -> Column:
    """At most five parts of a description at its temporal connectors; an unknown X of `source` becomes [TARGET] and is bound to a part.

    If X isn't in the text, referring phrases stand for it; if there are none, the
    parts with words of direct handling get it, else the first one.
    """
    unknown = bounded("[Xx]")
    has_target = source.rlike(unknown)
    marked = F.regexp_replace(text, unknown, TARGET)
    marked = F.when(has_target & ~F.contains(marked, F.lit(TARGET)), F.regexp_replace(marked, "(?iu)" + bounded(REFERRING), TARGET)).otherwise(marked)
    split = F.transform(F.split(marked, "(?iu)" + bounded(CONNECTORS)), lambda p: stripped(p, " ,.;:-"))
    parts = F.slice(F.filter(split, lambda p: p != ""), 1, MOST_EVENTS)
    parts = F.when(F.size(parts) > 0, parts).otherwise(F.array(marked))
    handled = F.transform(parts, lambda p: F.when(p.rlike("(?iu)" + bounded(HANDLING) + "|" + bounded(r"\d+\s+con")), F.concat(p, F.lit(f" {TARGET}"))).otherwise(p))
    first = F.transform(parts, lambda p, i: F.when(i == 0, F.concat(p, F.lit(f" {TARGET}"))).otherwise(p))
    holds = lambda a: F.exists(a, lambda p: F.contains(p, F.lit(TARGET)))
    return F.when(~has_target | holds(parts), parts).when(holds(handled), handled).otherwise(first)


def event_list(text: Column, context: Column) -> Column:
    """Events of a multi-line request: lines "E1:", "Event 1:" or "1." begin one, others continue it; what comes before the first is context of all.

    Without such lines the whole text is one event.
    """
    bare = lambda t: F.regexp_replace(t, OUTER_SPACE, "")
    lines = F.filter(F.transform(F.split(text, "\n"), bare), lambda t: t != "")
    mark = r"(?i)^(?:E\d+|Event\s*\d+|\d+)\s*[:.]\s*(.*)$"
    none = F.struct(bare(F.coalesce(context, F.lit(""))).alias("context"), F.array().cast("array<string>").alias("events"))

    def add(acc: Column, line: Column) -> Column:
        events, head = acc["events"], line.rlike(mark)
        ahead = F.trim(F.concat(acc["context"], F.lit(" "), line))
        longer = F.concat(F.slice(events, 1, F.size(events) - 1), F.array(F.trim(F.concat(F.element_at(events, -1), F.lit(" "), line))))
        put = F.when(head, F.concat(events, F.array(F.trim(F.regexp_extract(line, mark, 1))))).when(F.size(events) == 0, events).otherwise(longer)
        return F.struct(F.when(~head & (F.size(events) == 0), ahead).otherwise(acc["context"]).alias("context"), put.alias("events"))

    found = F.aggregate(lines, none, add)
    # A text without headers is context alone: then the request itself is the event, behind that context as for any other.
    events = F.when(F.size(found["events"]) > 0, found["events"]).otherwise(F.array(bare(text)))
    return F.when(found["context"] != "", F.transform(events, lambda e: F.trim(F.concat(found["context"], F.lit(" "), e)))).otherwise(events)


def constraint_specs(parts: Column, kind: Column) -> Column:
    """(constraint_id, kind, event_index, value) of events (text parts in order) and an answer kind."""
    row = lambda i, k, e, v: F.struct(i.alias("constraint_id"), F.lit(k).alias("kind"), e.cast("int").alias("event_index"), v.cast("string").alias("value"))
    none = F.lit(None)
    entity = F.when(kind.isin("food", "object"), F.array(row(F.lit("TARGET_ENTITY_TYPE"), "entity_type", none, kind)))
    bearing = F.filter(F.transform(parts, lambda p, i: F.struct(i.alias("i"), F.contains(p, F.lit(TARGET)).alias("on"), x.folded_words(p).alias("w"))), lambda e: e["on"])
    number = F.map_from_arrays(F.array(*[F.lit(n) for n in NUMBERS]), F.array(*[F.lit(str(v)) for v in NUMBERS.values()]))

    def of(e: Column) -> Column:
        raw = F.regexp_extract(e["w"], r"\b([0-9]+|mot|hai|ba|bon|nam)\s+(?:con\s+)?target\b", 1)
        n = F.coalesce(F.try_element_at(number, raw), F.regexp_replace(raw, "^0+(?=.)", ""))
        name = lambda tail: F.concat(F.lit("E"), e["i"].cast("string"), F.lit(tail))
        has = lambda *words: e["w"].rlike(rf"(?:^| )(?:{'|'.join(words)})(?: |$)")
        return F.array_compact(
            F.array(
                F.when(raw != "", row(F.concat(name("_COUNT_"), n), "count", e["i"], n)),
                F.when(has("dat", "de", "place", "put") & has("dia", "plate"), row(name("_ON_PLATE"), "relation", e["i"], F.lit("on_plate"))),
                F.when(has("cam", "hold", "holding"), row(name("_HELD"), "action", e["i"], F.lit("held"))),
            )
        )

    sequence = F.array_join(F.transform(bearing, lambda e: e["i"].cast("string")), "_")
    same = F.array(row(F.concat(F.lit("TARGET_SAME_IDENTITY_"), sequence), "same_identity", none, sequence), row(F.concat(F.lit("ORDER_"), sequence), "order", none, sequence))
    several = F.when(F.size(bearing) > 1, same)
    empty = F.slice(same, 1, 0)
    return F.concat(F.coalesce(entity, empty), F.flatten(F.transform(bearing, of)), F.coalesce(several, empty))


def target_safe(text: Column, language: str, kind: Column) -> Column:
    """A search text that names the unknown target by its kind alone."""
    word = F.lit(SAFE_DEFAULT[language])
    for k, w in SAFE[language].items():
        word = F.when(kind == k, F.lit(w)).otherwise(word)
    marked = F.regexp_replace(text, "(?iu)" + BEFORE + r"con\s+\[TARGET\]", TARGET) if language == "vi" else text
    return F.replace(F.regexp_replace(marked, r"(?i)\[target\]", TARGET), F.lit(TARGET), word)


def focused(text: Column, language: str) -> Column:
    """The short action phrase of a target-safe event, empty if there is none."""
    clean = stripped(x.squeezed(text), " ,.;:")
    if language == "en":
        focus = stripped(F.regexp_extract(clean, rf"(?i)\b(?:{PLACING})\s+(.+)$", 1), " ,.;:")
        held = clean.rlike(rf"(?i)\b(?:{HOLDING})\b") & ~focus.rlike(r"(?i)\bhands?\b")
        return F.when(focus == "", F.lit("")).when(held, F.concat(focus, F.lit(" in hands"))).otherwise(focus)
    words, count = x.folded_words(clean), r"(1|2|3|4|5|mot|hai|ba|bon|nam)"
    plate, hand = rf"\bdia\b.*?\b{count}\b\s+(.+)$", rf"\b(?:cam|giu)\b.*?\b{count}\b\s+(.+)$"
    said = lambda p, tail: F.concat(F.regexp_extract(words, p, 1), F.lit(" "), F.regexp_extract(words, p, 2), F.lit(tail))
    return (
        F.when(F.contains(words, F.lit("dat")) & F.contains(words, F.lit("dia")) & words.rlike(plate), said(plate, " tren dia trang"))
        .when(F.contains(words, F.lit("cam")) & words.rlike(hand), said(hand, " tren tay"))
        .otherwise(F.lit(""))
    )


def event_variants(text: Column, language: str, kind: Column, bearing: Column) -> Column:
    """Search texts of an event in a language: the target-safe one, and its short action phrase if it bears the answer."""
    safe = target_safe(text, language, kind)
    short = focused(safe, language)
    return x.unique_strings(F.when(bearing & (short != "") & (short != safe), F.array(safe, short)).otherwise(F.array(safe)))


def caption_queries(en: Column, vi: Column) -> Column:
    """The last (shortest) variant of each language, once each."""
    return x.unique_strings(F.array_compact(F.array(F.try_element_at(en, F.lit(-1)), F.try_element_at(vi, F.lit(-1)))))


def track_text(track: Column, query: Column, context: Column) -> Column:
    """What a track searches for: context first where a scene is set before the question; empty or unknown requests are errors."""
    part = lambda c: F.nullif(F.trim(c), F.lit(""))
    name = F.lower(F.trim(track))
    joined = F.when(name.isin("vqa", "trake"), F.concat_ws(" ", part(context), part(query))).otherwise(F.concat_ws(" ", part(query), part(context)))
    known = F.when(name.isin(*TRACKS), joined).otherwise(F.raise_error(F.concat(F.lit("unsupported track: "), F.coalesce(track, F.lit("null")))))
    return F.when(known == "", F.raise_error(F.lit("the query text is empty"))).otherwise(known)


# The tracks of requests.
TRACKS = ("textual_kis", "video_kis", "vqa", "trake")
