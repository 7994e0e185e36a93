"""Rules of ingest, routing and exposure as Column expressions; phrases are parameters, with fixed values as defaults."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import BLANK, FOLD

# Lines of legal texts, and how they are written in Markdown (before and after the line).
LEGAL = (
    (r"^(PHẦN|CHƯƠNG|MỤC)\s+[IVXLC\d]+", "## ", ""),
    (r"^Điều\s+\d+[\.:]?", "### ", ""),
    (r"^Khoản\s+\d+[\.:]?", "- **", "**"),
    (r"^[a-zđ]\)\s+", "  - ", ""),
)
# Headings of legal texts, lines that head or foot their pages (the last two also within a line), and their motto.
LEGAL_HEADING = (r"^(PHẦN|CHƯƠNG|MỤC)\s+[IVXLC\d]+", r"^Điều\s+\d+[\.:]", r"^Khoản\s+\d+[\.:]", r"^[a-zđ]\)\s+")
PAGE, NUMBER = r"^(Trang|Page)\s*\d+(?:\s*/\s*\d+)?$", r"^Số\s*:\s*[^\s]+"
PLACE_DATE = r"(Hà Nội|Huế|TP\.?\s*Hồ Chí Minh|Đà Nẵng).*ngày\s+\d{1,2}\s+tháng\s+\d{1,2}\s+năm\s+\d{4}"
MOTTO = ("CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM", "ĐỘC LẬP - TỰ DO - HẠNH PHÚC")
# What ends a line.
LINE_END = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]"
# Words by which a question asks for earlier years.
HISTORICAL = r"\b(so sánh|so sanh|đối chiếu|doi chieu|thay đổi|thay doi|tăng|giảm|so với|so voi|năm\s+\b20\d{2}\b|năm\s+(trước đó|năm trước)|trước|cũ|historical|vs|năm\s+20\d{2})\b"
# Words by which a question asks for a list of programmes, and the chunk type that answers it.
LIST_WORDS, LIST_TYPE = ("các ngành", "danh sách ngành", "có ngành nào", "ngành nào"), "thong_tin_nganh"


def _trim(text: str | Column) -> Column:
    return F.btrim(text, F.lit(BLANK))


def _any(*patterns: str) -> str:
    """One pattern for several, so that a line is read once."""
    return FOLD + "|".join(f"(?:{p})" for p in patterns)


def legal_line(line: str | Column, rules: tuple[tuple[str, str, str], ...] = LEGAL) -> Column:
    """A trimmed line of a legal text as Markdown, by the first rule that matches (FN4)."""
    t = _trim(line)
    out = F.when(~t.rlike(_any(*[p for p, _, _ in rules])), t)  # most lines are of no kind, which one pattern tells
    for pattern, before, after in rules:
        out = out.when(t.rlike(FOLD + pattern), F.concat(F.lit(before), t, F.lit(after)))
    return out.otherwise(t)


def legal_heading(line: Column) -> Column:
    """Whether a trimmed line is a heading of a legal text (FIL14)."""
    return line.rlike(_any(*LEGAL_HEADING))


def header_footer(line: Column) -> Column:
    """Whether a trimmed line heads or foots a page: its number, the document's, place and date, or the motto (FIL14)."""
    upper = F.upper(line)
    return line.rlike(_any(PAGE, PLACE_DATE)) | line.rlike(NUMBER) | reduce(lambda a, b: a | b, [F.contains(upper, F.lit(m)) for m in MOTTO])


def stripped(text: Column) -> Column:
    """text without white space of any script at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def heading(value: str | Column, most: int = 120, default: str = "Chunk") -> Column:
    """A name as a heading: runs of underscores and hyphens as spaces, at most `most` characters (FN5)."""
    v = _trim(F.regexp_replace(value, r"[_\-]+", " "))
    return F.when(v == "", default).otherwise(F.substring(v, 1, most))


def with_heading(text: str | Column, name: str | Column) -> Column:
    """A text below its heading, unless it has Markdown headings or nothing at all (FN5)."""
    body = _trim(text)
    own = F.startswith(body, F.lit("#")) | F.contains(body, F.lit("\n## ")) | F.contains(body, F.lit("\n### "))
    return F.when((body == "") | own, body).otherwise(F.concat(F.lit("### "), heading(name), F.lit("\n\n"), body))


def safe_id(value: str | Column, default: str = "doc") -> Column:
    """Letters, digits and underscores, other characters as single underscores, none at the ends (FN6)."""
    s = F.btrim(F.regexp_replace(_trim(value), "[^a-zA-Z0-9_]+", "_"), F.lit("_"))
    return F.when(s == "", default).otherwise(s)


def trailing_number(value: str | Column, default: Column | int) -> Column:
    """The number at the end of an id, else `default` (FN6)."""
    return F.coalesce(F.nullif(F.regexp_extract(value, r"([0-9]+)$", 1), F.lit("")).try_cast("long"), F.lit(default) if isinstance(default, int) else default)


def canonical_chunk(index: Column, order: str = "n") -> list[Column]:
    """The fields of a chunk object (columns id, doc_id, chunk_id, title, text, text_plain, content, source), coalesced (FN7).

    The text is the first that isn't blank of text, text_plain and content, else the whole object as JSON.
    """
    filled = lambda c: F.when(_trim(c) != "", F.col(c))
    doc = safe_id(F.coalesce(filled("doc_id"), filled("source"), F.lit("")))
    number = trailing_number(F.coalesce("chunk_id", F.lit("")), index)
    whole = F.to_json(F.struct("id", "doc_id", "chunk_id", "title", "source"))
    text = F.coalesce(filled("text"), filled("text_plain"), filled("content"), whole)
    return [
        F.coalesce(filled("id"), F.concat(doc, F.lit("_"), number.cast("string"))).alias("id"),
        doc.alias("doc_id"),
        number.alias("chunk_id"),
        with_heading(text, F.coalesce(filled("title"), doc)).alias("text"),
        F.coalesce(filled("source"), F.lit("unknown")).alias("source"),
    ]


def historical(text: str | Column, pattern: str = HISTORICAL) -> Column:
    """Whether a question is about earlier years (FN17)."""
    t = F.col(text) if isinstance(text, str) else text
    return t.rlike(FOLD + pattern)


def any_of(text: str | Column, words: tuple[str, ...]) -> Column:
    """Whether the lower-cased text holds one of the words."""
    low, out = F.lower(text), F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def faq_types(text: str | Column, rules: list[tuple[tuple[str, ...], tuple[str, ...]]], list_words: tuple[str, ...] = LIST_WORDS, list_type: str = LIST_TYPE) -> Column:
    """The chunk types that may answer a question, as an OR group, or null for all (FIL11).

    rules: (words, types), the first whose words occur decides; then list_words ask for list_type.
    """
    out = F.when(F.lit(False), F.array(F.lit("")))
    for words, types in rules:
        out = out.when(any_of(text, words), F.array(*[F.lit(t) for t in types]))
    return out.when(any_of(text, list_words), F.array(F.lit(list_type)))


def entity_count(text: str | Column, patterns: list[str]) -> Column:
    """How many different entities of all patterns a text names; case doesn't matter (FN31)."""
    each = [F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(FOLD + f"({p})"), F.lit(0)), lambda x: F.lower(x))) for p in patterns]
    return sum((F.size(e) for e in each[1:]), F.size(each[0]))


def seeds(question: str | Column, step_back: str | Column, variants: str | Column, pattern: str, most: int = 3) -> Column:
    """Entities of the question, then those of its step-back form and first variants, each at its first place (ST-U2)."""
    found = lambda t: F.regexp_extract_all(t, F.lit(FOLD + f"({pattern})"), F.lit(0))
    more = F.array_compact(F.concat(F.array(step_back), F.slice(variants, 1, most)))
    both = F.concat(found(F.coalesce(question, F.lit(""))), found(F.array_join(F.filter(more, lambda x: x != ""), "\n")))
    return F.array_distinct(F.transform(both, lambda x: F.lower(x)))


def public_status(code: str | Column, mode: str, other: str = "OUT_OF_SCOPE") -> Column:
    """What callers see of an internal code: in production only success and personal data, and `other` for the rest (FN36)."""
    c = F.col(code) if isinstance(code, str) else code
    if mode.lower() != "prod":
        return c
    return F.when(c.isin("SUCCESS", "SENSITIVE_PII_DETECTED"), c).otherwise(other)


def normal_output(mode: str = "v2") -> list[Column]:
    """answer, context_chunks, source_ids of raw answers (columns answer, chunks, sources): v1 has no sources (FN43)."""
    none = F.array().cast("array<string>")
    ids = F.coalesce("sources", none) if mode == "v2" else none
    return [F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("chunks", none).alias("context_chunks"), ids.alias("source_ids")]
