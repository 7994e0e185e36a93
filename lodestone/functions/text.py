"""Scalar text functions as Column expressions; patterns are fixed values unless a parameter."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Case is ignored and words end where letters end, beyond ASCII too.
FOLD = "(?iuU)"
# Patterns by which phrases are recognised (case doesn't matter).
YEAR = r"\b(199\d|20[0-3]\d)\b"
NOW = r"\b(năm\s+nay|hiện\s+tại|năm\s+hiện\s+tại|hiện\s+nay)\b"
BEFORE = r"\b(năm\s+trước|năm\s+ngoái|năm\s+cũ|năm\s+rồi)\b"
ACROSS = r"\b(so\s+sánh|đối\s+chiếu|qua\s+các\s+năm|từng\s+năm|theo\s+năm|giữa\s+các\s+năm)\b"
RELATIVE = [
    (r"năm\s+nay", 0),
    (r"hiện\s+tại", 0),
    (r"hiện\s+nay", 0),
    (r"năm\s+hiện\s+tại", 0),
    (r"năm\s+ngoái", -1),
    (r"năm\s+trước", -1),
    (r"năm\s+rồi", -1),
    (r"năm\s+cũ", -1),
    (r"năm\s+sau", 1),
    (r"năm\s+tới", 1),
    (r"sang\s+năm", 1),
]
INTENTS = [
    ("diem_chuan", r"điểm\s+(chuẩn|trúng\s+tuyển)"),
    ("hoc_phi", r"học\s*phí"),
    ("chi_tieu", r"(chỉ\s+tiêu|số\s+lượng\s+tuyển|quota)"),
    ("da_hop", r"tổ\s+hợp\s+(đã\s+hợp|xét\s+tuyển|môn|thi)"),
]
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"\b(?:\+?84|0)(?:[\s.-]?[0-9]){8,10}\b"
CITIZEN = r"\b[0-9]{12}\b"
PII_WORDS = ("cccd", "cmnd", "số căn cước", "số tài khoản", "mật khẩu", "otp", "cvv")
# Letters that are written without their accents, by plain letter; doubly accented ones stay.
UNACCENTED = (
    ("a", "ăâáàảãạ"),
    ("e", "êéèẻẽẹ"),
    ("o", "ôơóòỏõọ"),
    ("u", "ưúùủũụ"),
    ("i", "íìỉĩị"),
    ("d", "đ"),
    ("y", "ýỳỷỹỵ"),
)
# Stop words of sparse terms.
STOPWORDS = ("và", "các", "của", "có", "được", "cho", "trong", "là", "một", "này", "để", "với", "theo", "từ", "đã", "sẽ", "không", "khi", "bằng")
# Marks that a normal answer leaves out.
MARKS = ".,;:!?-()[]{}\"'_"


def slug(text: str | Column, default: str = "doc") -> Column:
    """Lower case, other than a-z and 0-9 as single underscores, none at the ends; `default` if nothing is left (FN1)."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s == "", default).otherwise(s)


def stable_id(name: Column, path: Column) -> Column:
    """slug, underscore, first eight hex digits of the path's SHA-1 (FN2)."""
    return F.concat(slug(name), F.lit("_"), F.substring(F.sha1(path.cast("binary")), 1, 8))


def whole_number(text: Column) -> Column:
    """A long if the text is digits only, else null (FN3)."""
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("long"))


def decimal_comma(text: Column) -> Column:
    """The first number, comma or point as the decimal mark; null for none or a negative one (FN20)."""
    m = F.regexp_extract(text, r"-?[0-9]+([.,][0-9]+)?", 0)
    n = F.regexp_replace(m, ",", ".").try_cast("double")
    return F.when(n >= 0, n)


def sparse_terms(text: Column, stop: tuple[str, ...] = STOPWORDS, most: int | None = None) -> Column:
    """Words of letters, digits and underscores, lower case, without stop words and words of two letters or fewer; the first `most` (FN8)."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    kept = F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*stop))
    return kept if most is None else F.slice(kept, 1, most)


def unaccent(text: str | Column) -> Column:
    """Lower case with the letters of UNACCENTED folded, and no others (FN10)."""
    return F.translate(F.lower(text), "".join(letters for _, letters in UNACCENTED), "".join(plain * len(letters) for plain, letters in UNACCENTED))


ASCII = r"^\p{ASCII}*$"
BLANK = " \t\n\r\f\v"


@F.pandas_udf(StringType())
def _unmarked(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


@F.pandas_udf(StringType())
def _decomposed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))


def fold(text: str | Column) -> Column:
    """Decomposed (NFKD), without combining marks, lower case, trimmed; other letters such as đ stay (FN9).

    Decomposition is what Spark has no function for; ASCII texts pass by it.
    """
    t = F.col(text) if isinstance(text, str) else text
    return F.btrim(F.lower(F.when(t.rlike(ASCII), t).otherwise(_unmarked(t))), F.lit(BLANK))


def normal_answer(text: str | Column) -> Column:
    """Lower case, decomposed (NFKD, marks kept), trimmed, white space collapsed, without MARKS (FN11)."""
    t = F.col(text) if isinstance(text, str) else text
    low = F.lower(t)
    return F.translate(F.regexp_replace(F.btrim(F.when(low.rlike(ASCII), low).otherwise(_decomposed(low)), F.lit(BLANK)), r"\s+", " "), MARKS, "")


def years(text: str | Column) -> Column:
    """All years from 1990 to 2039, in order (FN13)."""
    return F.transform(F.regexp_extract_all(text, F.lit(YEAR), F.lit(1)), lambda y: y.cast("int"))


def temporal_intent(text: Column, current: int | Column) -> Column:
    """cross_year, current, historical or ambiguous: phrases before explicit years (FN15)."""
    y = F.get(years(text), F.lit(0))
    return (
        F.when(text.rlike(FOLD + ACROSS), "cross_year")
        .when(text.rlike(FOLD + NOW), "current")
        .when(text.rlike(FOLD + BEFORE), "historical")
        .when(y >= current, "current")
        .when(y < current, "historical")
        .otherwise("ambiguous")
    )


def with_years(text: Column, current: int) -> Column:
    """Relative phrases as `năm <year>`, unless the text names a year of the 2020s or 2030s (FN14)."""
    out = text
    for pattern, offset in RELATIVE:
        out = F.regexp_replace(out, FOLD + pattern, f"năm {current + offset}")
    return F.when(text.rlike(r"\b20[2-3][0-9]\b"), text).otherwise(out)


def first_match(text: Column, rules: list[tuple[str, str]] = INTENTS) -> Column:
    """The label of the first rule that matches, or null (FN16)."""
    out = F.when(F.lit(False), F.lit(""))
    for label, pattern in rules:
        out = out.when(text.rlike(FOLD + pattern), label)
    return out


def has_pii(text: Column) -> Column:
    """A keyword, an e-mail address, a phone number or twelve digits (FIL21)."""
    return F.lower(text).rlike("|".join(PII_WORDS)) | (F.contains(text, F.lit("@")) & text.rlike(EMAIL)) | text.rlike(PHONE) | text.rlike(CITIZEN)


def year_clause(intent: str, year: int, column: str = "data_year") -> Column | None:
    """The pushable filter of an intent, None if it has none; ValueError for a year out of 2020 .. 2039 (FIL6)."""
    if isinstance(year, bool) or not isinstance(year, int) or not 2020 <= year <= 2039:
        raise ValueError(f"year {year!r}")
    return {"current": F.col(column) == year, "historical": F.col(column) < year}.get(intent)


def cache_key(text: Column) -> Column:
    """First sixteen hex digits of the SHA-256 of the text in lower case with white space collapsed (STM2)."""
    return F.substring(F.sha2(F.regexp_replace(F.lower(F.trim(text)), r"\s+", " "), 256), 1, 16)


def recommendation(delta: Column) -> Column:
    """an_toan from 2, can_nhac from -1, else mao_hiem (FN19)."""
    return F.when(delta >= 2, "an_toan").when(delta >= -1, "can_nhac").otherwise("mao_hiem")


def band(delta: Column) -> Column:
    """Four bands by 3, 1 and -1 (FN19)."""
    return F.when(delta >= 3, "rất cao").when(delta >= 1, "cao").when(delta >= -1, "trung bình").otherwise("thấp")
