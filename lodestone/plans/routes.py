"""Queries of ingest rules, router rules, route dispatch and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import rules, scope
from lodestone.operators import fusion, metrics
from lodestone.plans.registry import query, table
from lodestone.plans.retrieval import _DENSE, dense
from lodestone.sources import tables

_LINES = ["CHƯƠNG IV Tuyển sinh", " Điều 5. Hồ sơ", "khoản 2: Thời hạn", "a) bản sao", "đ) ảnh", "Điều kiện", "", "mục 3"]
_LINE_SQL = "l AS (SELECT doc_id, trim(([" + ", ".join(f"'{x}'" for x in _LINES) + f"])[1 + doc_id % {len(_LINES)}] || ' ' || source) AS line FROM documents)"


@query(f"WITH {_LINE_SQL} SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(line, '(?i){p}') THEN '{x}' || line || '{y}'" for p, x, y in rules.LEGAL) + " ELSE line END AS line FROM l")
def legal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN4: a line of a legal text for each document, its source behind it."""
    line = F.concat(F.get(F.array(*map(F.lit, _LINES)), (F.col("doc_id") % len(_LINES)).cast("int")), F.lit(" "), "source")
    return table(spark, sf_dir, "documents").select("doc_id", rules.legal_line(line).alias("line"))


@query(r"""SELECT doc_id, coalesce(nullif(trim(regexp_replace(source, '[^a-zA-Z0-9_]+', '_', 'g'), '_'), ''), 'doc') AS safe, CAST(coalesce(nullif(regexp_extract(source, '([0-9]+)$', 1), ''), '7') AS BIGINT) AS number,
CASE WHEN trim(regexp_replace(source, '[_\-]+', ' ', 'g')) = '' THEN 'Chunk' ELSE substr(trim(regexp_replace(source, '[_\-]+', ' ', 'g')), 1, 120) END AS heading,
md5(CASE WHEN b = '' OR starts_with(b, '#') OR contains(b, chr(10) || '## ') OR contains(b, chr(10) || '### ') THEN b ELSE '### ' || substr(trim(regexp_replace(source, '[_\-]+', ' ', 'g')), 1, 120) || chr(10) || chr(10) || b END) AS digest
FROM (SELECT *, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS b FROM documents)""")
def chunk_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN5, FN6."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", rules.safe_id("source").alias("safe"), rules.trailing_number("source", 7).alias("number"), rules.heading("source").alias("heading"), F.md5(rules.with_heading("text", "source").cast("binary")).alias("digest")
    )


_FAQ = [(("here", "there"), ("summary", "program", "overview")), (("tion",), ("hoc_phi",))]


@query("""SELECT conv_id, turn, CASE WHEN contains(lower(text), 'here') OR contains(lower(text), 'there') THEN ['summary', 'program', 'overview'] WHEN contains(lower(text), 'tion') THEN ['hoc_phi'] WHEN contains(lower(text), 'ing') THEN ['thong_tin_nganh'] END AS types FROM conversations""")
def faq_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL11: an OR group of chunk types by words of the question."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", rules.faq_types("text", _FAQ, ("ing",)).alias("types"))


_ASKED = ["Điểm năm 2024", "học phí giảm không", "giảmx", "học phí", "CNTT VS luật", "cũng được", "so sánh", "năm trước đó", "năm 20245"]
_WORDS = rules.HISTORICAL.removeprefix(r"\b").removesuffix(r"\b").replace(r"\b", "")


@query(rf"""WITH p AS (SELECT conv_id, turn, ([{", ".join(f"'{x}'" for x in _ASKED)}])[1 + (conv_id + turn) % {len(_ASKED)}] || ' ' || text AS text FROM conversations)
SELECT conv_id, turn, regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}_])({_WORDS})($|[^\p{{L}}\p{{N}}_])') AS historical FROM p""")
def historical_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN17: all turns, each behind a question."""
    asked = F.concat(F.get(F.array(*map(F.lit, _ASKED)), ((F.col("conv_id") + F.col("turn")) % len(_ASKED)).cast("int")), F.lit(" "), "text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", rules.historical(asked).alias("historical"))


@query(r"""SELECT conv_id, turn, CAST(len(list_distinct(list_transform(regexp_extract_all(text, '(?i)th[a-z]+re'), lambda x: lower(x)))) + len(list_distinct(list_transform(regexp_extract_all(text, '(?i)er[a-z]+'), lambda x: lower(x)))) AS INTEGER) AS entities,
list_sort(list_distinct(list_transform(regexp_extract_all(text || chr(10) || lower(text) || chr(10) || role, '(?i)th[a-z]+re'), lambda x: lower(x)))) AS seeds FROM conversations""")
def entity_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN31, ST-U2: entities named, and seeds out of a question, its step-back form and its variants (sorted here)."""
    more = rules.seeds("text", F.lower("text"), F.array("role"), "th[a-z]+re")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", rules.entity_count("text", ["th[a-z]+re", "er[a-z]+"]).alias("entities"), F.sort_array(more).alias("seeds"))


_CODES = "CASE event_type WHEN 'view' THEN 'SUCCESS' WHEN 'click' THEN 'SENSITIVE_PII_DETECTED' ELSE upper(event_type) END"


@query(f"SELECT event_id, CASE WHEN c IN ('SUCCESS', 'SENSITIVE_PII_DETECTED') THEN c ELSE 'OUT_OF_SCOPE' END AS prod, c AS dev FROM (SELECT event_id, {_CODES} AS c FROM events)")
def public_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN36."""
    e = table(spark, sf_dir, "events").select("event_id", F.expr(_CODES).alias("c"))
    return e.select("event_id", rules.public_status("c", "prod").alias("prod"), rules.public_status("c", "dev").alias("dev"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS answer, CASE WHEN doc_id % 2 = 0 THEN [source] ELSE [] END AS source_ids FROM documents")
def output_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN43: missing fields as empty ones."""
    d = table(spark, sf_dir, "documents")
    raw = d.select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("answer"), F.array("lang").alias("chunks"), F.when(F.col("doc_id") % 2 == 0, F.array("source")).alias("sources"))
    return raw.select("doc_id", *rules.normal_output("v2")).drop("context_chunks")


_PLAY = f"""WITH {_DENSE}, b AS (SELECT qid, vec_id AS doc_id, score, rank FROM dr WHERE rank <= 12),
p AS (SELECT vec_id AS qid, vec_id + i AS doc_id, 1.0 / (2 + i) AS ppr FROM v, range(0, 20) AS t(i) WHERE vec_id % 50 = 0),
rt AS (SELECT vec_id AS qid, CASE vec_id // 50 % 3 WHEN 0 THEN 'padded' WHEN 1 THEN 'hybrid' ELSE 'graph' END AS route FROM v WHERE vec_id % 50 = 0),
n AS (SELECT p.qid, p.doc_id, row_number() OVER (PARTITION BY p.qid ORDER BY ppr DESC, p.doc_id) AS r FROM p ANTI JOIN b USING (qid, doc_id)),
x AS (SELECT qid, doc_id, 0.0 AS score, true AS injected FROM n JOIN rt USING (qid) WHERE r <= CASE route WHEN 'hybrid' THEN 5 WHEN 'graph' THEN 8 ELSE 0 END UNION ALL SELECT qid, doc_id, score, false FROM b),
m AS (SELECT qid, max(score) AS top FROM x GROUP BY qid),
f AS (SELECT x.qid, x.doc_id, injected, CASE WHEN route = 'padded' THEN x.score ELSE 0.6 * CASE WHEN top > 0 THEN x.score / top ELSE x.score END + 0.4 * coalesce(ppr, 0) END AS fused
  FROM x JOIN rt USING (qid) JOIN m USING (qid) LEFT JOIN p ON p.qid = x.qid AND p.doc_id = x.doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(fused, 12) DESC, doc_id) AS place FROM f)
"""


@query(_PLAY + "SELECT qid, doc_id, injected, round(fused, 6) AS fused, CAST(place AS INTEGER) AS place FROM k WHERE place <= 5")
def route_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RTE1: padded questions keep the first results, hybrid ones fuse up to five graph results in, graph ones up to eight."""
    base = dense(spark, sf_dir, 12).select("qid", F.col("vec_id").alias("doc_id"), "score", "rank")
    asked = table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"))
    i = F.explode(F.sequence(F.lit(0), F.lit(19)))
    ppr = asked.select("qid", i.alias("i")).select("qid", (F.col("qid") + F.col("i")).alias("doc_id"), (1.0 / (2 + F.col("i"))).alias("ppr"))
    n = F.floor(F.col("qid") / 50) % 3
    routes = asked.select("qid", F.when(n == 0, "padded").when(n == 1, "hybrid").otherwise("graph").alias("route"))
    out = fusion.dispatch(base, ppr, routes, 5)
    return out.select("qid", "doc_id", "injected", F.round("fused", 6).alias("fused"), "place")


@query(f"""WITH {_DENSE}, o AS (SELECT qid, doc_id, 0.6 / (60 + max(rank)) AS s FROM (SELECT qid, vec_id // 3 AS doc_id, rank FROM dr WHERE rank <= 20) GROUP BY ALL),
t AS (SELECT qid, vec_id AS doc_id, 0.4 / (60 + rank) AS s FROM dr WHERE rank <= 10)
SELECT qid, doc_id, round(sum(s), 9) AS score FROM (SELECT * FROM o UNION ALL SELECT * FROM t) GROUP BY qid, doc_id""")
def rrf_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RRF2: as RRF1, but of a document that the dense list has twice the later rank counts."""
    d = dense(spark, sf_dir, 20)
    one = d.select("qid", F.floor(F.col("vec_id") / 3).alias("doc_id"), "rank").groupBy("qid", "doc_id").agg(F.max("rank").alias("rank"))
    two = d.filter("rank <= 10").select("qid", F.col("vec_id").alias("doc_id"), "rank")
    return fusion.rrf([(one, 0.6), (two, 0.4)]).select("qid", "doc_id", F.round("score", 9).alias("score"))


@query("SELECT p_brand AS code, p_type AS method, CAST(1990 + p_partkey % 8 AS INTEGER) AS year, p_partkey FROM part ORDER BY year DESC, code, method")
def history_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK6: latest years first, then code and method."""
    h = table(spark, sf_dir, "part").select(F.col("p_brand").alias("code"), F.col("p_type").alias("method"), (1990 + F.col("p_partkey") % 8).cast("int").alias("year"), "p_partkey")
    return h.orderBy(F.desc("year"), "code", "method")


@query(f"WITH {_DENSE}, c AS (SELECT qid, vec_id, rank FROM dr WHERE rank <= 15) SELECT qid, vec_id, CAST(rank AS INTEGER) AS rank FROM c")
def program_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK7: three times as many candidates as asked for, and fifteen of them at most for a question about programmes."""
    return fusion.program_limit(dense(spark, sf_dir, 3 * 5), True).select("qid", "vec_id", "rank")


@query("SELECT event_type AS table_name, count(*) AS total, round(avg(CAST(event_id % 7 < 5 AS INTEGER)), 9) AS year_match_pct, round(avg(CAST(event_id % 11 < 9 AS INTEGER)), 9) AS scope_match_pct, round(avg(CAST(event_id % 5 < 4 AS INTEGER)), 9) AS grounded_pct FROM events GROUP BY event_type")
def smoke_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG42: shares of questions that pass, per table."""
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("table_name"), (i % 7 < 5).alias("year_match"), (i % 11 < 9).alias("scope_match"), (i % 5 < 4).alias("grounded"))
    return metrics.smoke_report(e, ["year_match", "scope_match", "grounded"], "table_name")


@query("SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS chunk_id, l_quantity FROM lineitem WHERE l_orderkey = 7 ORDER BY chunk_id")
def chunks_of_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC21: a point read of one document's chunks."""
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("chunk_id"), "l_quantity")
    return tables.chunks_of(t, 7)


# Questions with the programme that each names and whether it is out of scope.
_SCOPED = [
    ("Ngành Kinh Tế điểm chuẩn bao nhiêu", "Kinh Tế", True),
    ("Điểm chuẩn ngành Luật năm 2026", "Luật", True),
    ("Điểm chuẩn ngành Khoa học dữ liệu 2026", "Khoa học dữ liệu", False),
    ("học phí bao nhiêu", None, False),
    ("thời gian xét tuyển", None, False),
    ("nganh kinh te hoc phi bao nhieu", "kinh te", True),
    ("Ngành Y đa khoa điểm chuẩn", "Y đa khoa", True),
    ("Học phí ngành Công nghệ thông tin", "Công nghệ", False),
    ("ngành nào có học bổng", None, False),
    ("học toán", None, False),
    ("ngành Vũ trụ học là gì", "Vũ trụ học", True),
    ("Khoa học dữ liệu điểm chuẩn", "học dữ liệu", False),
    ("ký túc xá có không", None, False),
]
_OFFERED = ("khoa hoc du lieu", "cong nghe thong tin", "toan hoc", "hoa duoc")
_REFUSED = ("kinh te", "luat", "đa khoa", "duoc hoc")
_INTENT = ("hoc phi", "điem chuan", "ky tuc xa", "mien giam")


@query(
    "WITH s(k, phrase, out_of_scope) AS (VALUES " + ", ".join(f"({i}, {'NULL' if p is None else repr(p)}, {o})" for i, (_, p, o) in enumerate(_SCOPED)) + f") SELECT conv_id, turn, phrase, out_of_scope FROM conversations JOIN s ON k = (conv_id + turn) % {len(_SCOPED)}"
)
def scope_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN34, FN35: all turns, each behind a question; the programme that it names, and whether it is offered."""
    asked = F.concat(F.get(F.array(*[F.lit(q) for q, *_ in _SCOPED]), ((F.col("conv_id") + F.col("turn")) % len(_SCOPED)).cast("int")), F.lit("? "), "text")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", asked.alias("text"))
    return scope.decided(c, spark.createDataFrame([(w,) for w in _OFFERED], "word string"), _REFUSED, _INTENT).select("conv_id", "turn", "phrase", "out_of_scope")


_KINDS = [("em?", "vague"), ("hotline của trường", "contact"), ("trường có ngành gì, có zalo", None), ("liệt kê các ngành", "listing"), ("CNTT hay luật", "comparison"), ("so sanh diem", "comparison"), ("haya", None), ("học phí", None), ("...", "vague")]


@query("WITH s(k, kind) AS (VALUES " + ", ".join(f"({i}, {'NULL' if k is None else repr(k)})" for i, (_, k) in enumerate(_KINDS)) + f") SELECT doc_id, kind FROM documents JOIN s ON k = doc_id % {len(_KINDS)}")
def router_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN32: a question for each document."""
    asked = F.get(F.array(*[F.lit(q) for q, _ in _KINDS]), (F.col("doc_id") % len(_KINDS)).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", scope.asked_for(asked).alias("kind"))
