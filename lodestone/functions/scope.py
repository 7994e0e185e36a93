"""What programme a question is about, and whether it is offered (FN32, FN34, FN35); words are parameters, with fixed values as defaults."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.rules import any_of, stripped
from lodestone.functions.text import BLANK, FOLD
from lodestone.operators import matching
from lodestone.session import passing_path

# Letters of a name, and what stands at its ends.
NAME, MARKS = r"[A-Za-zÀ-ỹĐđ\-\s]", r"^[ ,.;:?!]+|[ ,.;:?!]+$"
# Words after which, or before which, a programme is named.
TAILS = ("điểm chuẩn", "diem chuan", "học phí", "hoc phi", "xét tuyển", "xet tuyen", "tổ hợp", "to hop", "chỉ tiêu", "chi tieu", "tuyển sinh", "tuyen sinh", "học bổng", "hoc bong", "chương trình", "chuong trinh", "ngành", "nganh", "mã ngành", "ma nganh", "thông tin", "thong tin")
LEADS = ("ngành", "nganh", "chuyên ngành", "chuyen nganh", "nghề", "nghe", "học", "hoc", "trường", "truong", "khoa", "đào tạo", "dao tao", "chương trình", "chuong trinh")
YEAR_END, GIST_END, BARE_YEAR_END = r"\s+(?:n[aă]m\s+\d{4}|\d{4})\s*$", r"\s+(?:n[aă]m\s+\d{4}|\d{4}|l[aà]\s+g[iì])\s*$", r"\s+n[aă]m\s*$"
# Folded phrases that name no programme, those of admission, and short words that are names only within longer ones.
NO_NAMES = ("thoi gian", "han", "truong", "khoa", "nha", "hoc", "bao nhieu", "nhu the nao", "the nao", "cach", "khi nao", "hoc phi", "diem chuan")
ADMISSION = ("mien giam", "ky tuc xa", "hoc phi", "le phi", "nguyen vong", "thi vao", "vao truong", "xet tuyen thang", "danh gia nang luc", "han nop", "tong hop mon", "ma nganh", "cong thong tin tuyen sinh", "chuong trinh dao tao", "diem san", "diem trung tuyen", "diem xet tuyen", "dang ky xet tuyen", "lien thong", "hoc ba", "vien phi", "nganh nghe", "xet tuyen", "tuyen sinh")
SHORT = ("toan", "van", "hoa", "ly", "su", "kt")
# Patterns of questions about a procedure, about any programme, and of what a name is not.
PROCESS = r"\b(?:đăng\s*k[ýyíi]|dang\s*k[yi]|nh[ậa]p\s*h[ọo]c|th[ủu]\s*t[ụu]c|n[ộo]p\s*h[ồo]\s*s[ơo]|x[eé]t\s*tuy[ểe]n|l[àa]m\s*sao|c[aá]ch|th[ủu]e|thue)\b"
ANY = r"\b(?:ng[aà]nh|nganh)\s+(?:n[aà]o|g[iì]|gi)\b"
ASKING = r"\b(b[aá]o nhi[eê]u|g[iì]|n[aà]o|th[eế] n[aà]o|ra sao|nh[uư] th[eế] n[aà]o|[oở] đ[aâ]u|khi n[aà]o)\b"
# Kinds of questions that a router knows by their words (case doesn't matter), in order of precedence.
VAGUE = r"(\.{3,}|…|_{3,}|^(?:em|e|cho\s+e|cho\s+em|hỏi|cho\s+hỏi|ad)\s*[?.!]*\s*$|^(?:gì|cái\s+gì|sao|thế\s+nào|như\s+thế\s+nào)\s*[?]?\s*$|^(?:hi|hello|chào|alo|test)\s*[?.!]*\s*$)"
CONTACT = r"(trang\s+web\s+của\s+trường|link\s+(?:của\s+)?trường|website\s+(?:của\s+)?trường|thông\s+tin\s+chung|trường\s+ở\s+đâu|địa\s+chỉ\s+(?:của\s+)?trường|liên\s+hệ\s+(?:với\s+)?trường|hotline|có\s+group|có\s+zalo|có\s+facebook|fanpage|giới\s+thiệu\s+về\s+trường)"
PROGRAMMES = r"(trường\s+có\s+ngành\s+gì|trường\s+có\s+những\s+ngành|tìm\s+hiểu\s+(?:về\s+)?các\s+ngành|ngành\s+gì|có\s+những\s+ngành)"
LISTING = r"(bao\s+nhiêu\s+ngành|tất\s+cả\s+các\s+ngành|danh\s+sách\s+ngành|liệt\s+kê|các\s+ngành\s+có|ngành\s+nào\s+có|các\s+ngành\s+thuộc|bao\s+nhiêu\s+chương\s+trình|toàn\s+bộ\s+ngành|danh\s+sách\s+các\s+ngành|các\s+ngành\s+đào\s+tạo|ngành\s+nào\s+đào\s+tạo|có\s+mấy\s+ngành|có\s+bao\s+nhiêu\s+ngành)"
COMPARISON = r"(so\s+s[áa]nh|kh[áa]c\s+nhau|so\s+v[ớo]i|ch[êe]nh\s+l[ệe]ch|\bh[ơo]n\b|\bk[éẻe]m\b|\bhay\b)"


@dataclass(frozen=True)
class Words:
    """What tells names from other words."""

    tails: tuple[str, ...] = TAILS
    leads: tuple[str, ...] = LEADS
    no_names: tuple[str, ...] = NO_NAMES
    admission: tuple[str, ...] = ADMISSION
    short: tuple[str, ...] = SHORT


def asked_for(text: str | Column) -> Column:
    """vague, contact, listing, comparison or null: what a router tells by patterns alone (FN32).

    A question about programmes isn't one for a contact, whatever else it says.
    """
    t = F.col(text) if isinstance(text, str) else text
    says = lambda p: t.rlike(FOLD + p)
    return F.when(says(VAGUE), "vague").when(says(CONTACT) & ~says(PROGRAMMES), "contact").when(says(LISTING), "listing").when(says(COMPARISON), "comparison")


def _candidates(q: Column, words: Words) -> list[Column]:
    """Names by each of four patterns, in order; empty where one doesn't match."""
    tail, own = "(?:" + "|".join(words.tails) + ")", r"(?:ngành|nganh)"
    find = lambda pattern: F.regexp_replace(F.regexp_extract(q, FOLD + pattern, 1), MARKS, "")
    drop = lambda c, *patterns: reduce(lambda a, p: stripped(F.regexp_replace(a, FOLD + p, "")), patterns, c)
    lead = r"^(?:" + "|".join(words.leads) + r")\s+"
    return [
        drop(find(rf"\b{own}\s+({NAME}{{3,}})"), rf"(?s){tail}.*$", GIST_END, BARE_YEAR_END),
        drop(find(rf"({NAME}{{3,}}?)\s+{tail}"), lead, YEAR_END),
        drop(find(rf"{tail}\s+{own}\s+({NAME}{{2,}})"), YEAR_END),
        drop(find(rf"^\s*({NAME}{{4,}}?)\s+{tail}"), YEAR_END),
    ]


def _is_name(phrase: Column, folded: Column, words: Words) -> Column:
    """Whether a phrase can name a programme: a word of three letters, no question, no word of admission."""
    long_ = F.exists(F.split(folded, r"[\s,;:/()\-]+"), lambda w: F.length(w) >= 3)
    return (F.length(phrase) >= 3) & folded.rlike(r"\p{L}") & long_ & ~folded.isin(*words.no_names, *words.short, *words.admission) & ~folded.rlike(FOLD + ASKING)


def named(questions: DataFrame, text: str = "text", words: Words | None = None) -> DataFrame:
    """questions with `phrase`, the programme that a question names, as it is written there, or null: by the first of four patterns
    whose phrase can be a name (FN34); `_folded`, the folded text, and `_f`, the folded phrase. Questions about procedures name none, and
    neither do short words alone.

    Each step has columns of its own, so that a pattern is matched once a row, and a row's phrases and text are folded at once.
    """
    known = words or Words()
    found = questions.withColumn("_s", stripped(F.col(text)))
    found = found.withColumns({f"_c{i}": c for i, c in enumerate(_candidates(F.col("_s"), known))})
    each = [F.col(f"_c{i}") for i in range(4)]
    # Phrases have letters, hyphens and white space only, so a zero character parts them; the text comes last.
    found = found.withColumn("_all", F.split(T.fold(F.concat_ws("\0", *each, F.coalesce("_s", F.lit("")))), "\0", 5))
    parts = [F.btrim(F.get("_all", F.lit(i)), F.lit(BLANK)) for i in range(5)]
    found = found.withColumns({"_fs": F.array(*parts[:4]), "_folded": F.when(F.col("_s").isNotNull(), parts[4])})
    allowed = ~F.col("_s").rlike(FOLD + PROCESS) & ~F.col("_folded").isin(*known.short)
    first = F.coalesce(*[F.when(_is_name(c, F.get("_fs", F.lit(i)), known), F.lit(i)) for i, c in enumerate(each)])
    found = found.withColumn("_first", F.when(allowed, first))
    return found.withColumns({"phrase": F.get(F.array(*each), F.col("_first")), "_f": F.get("_fs", F.col("_first"))}).drop("_s", "_all", "_fs", "_first", "_c0", "_c1", "_c2", "_c3")


def decided(questions: DataFrame, offered: DataFrame, refused: tuple[str, ...], admission: tuple[str, ...], text: str = "text", word: str = "word", words: Words | None = None) -> DataFrame:
    """questions with `phrase` and `out_of_scope` (FN35).

    offered: folded names, one to a row, on whose list a phrase is as in matching.either_way(); refused and admission: folded
    words. Out of scope is a question with a refused word, unless its phrase is offered, and one whose phrase isn't offered. In
    scope is one about any programme, about a procedure or about admission that names no programme. Null texts are in scope.
    """
    known, spark = words or Words(), questions.sparkSession
    numbered = questions.toDF(*[f"_q{i}" for i in range(len(questions.columns))])
    own = f"_q{questions.columns.index(text)}"
    q, folded = F.col(own), F.col("_folded")
    told = named(numbered, own, known).withColumns({"_any": q.rlike(FOLD + ANY), "_process": q.rlike(FOLD + PROCESS), "_about": any_of(folded, admission), "_refuses": any_of(folded, refused)}).drop("_folded")
    # Phrases are read twice, so what patterns tell of the texts is written first.
    path = passing_path(spark, "questions")
    told.write.parquet(path)
    told = spark.read.schema(told.schema).parquet(path)
    listed = matching.either_way(told.select(F.col("_f").alias("phrase")), offered.select(F.col(word).alias("word"))).select(F.col("phrase").alias("_known"))
    joined = told.join(listed, F.col("_f") == F.col("_known"), "left")
    none, is_known = F.col("phrase").isNull(), F.col("_known").isNotNull()
    spared = F.col("_any") | (F.col("_process") & none) | (F.col("_about") & (none | F.col("_f").isin(*known.admission)))
    out = F.when(spared, False).when(F.col("_refuses"), ~is_known).when(none, False).otherwise(any_of(F.col("_f"), refused) | ~is_known)
    return joined.select(*numbered.columns, "phrase", F.coalesce(out, F.lit(False))).toDF(*questions.columns, "phrase", "out_of_scope")
