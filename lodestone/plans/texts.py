"""Queries of chunking, cleaning, HTML and streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import rules, tables
from lodestone.operators import chunking, profiles
from lodestone.plans.registry import query, table
from lodestone.sources import html
from lodestone.streaming import windows


# What a page of a legal text has around its lines; every document gets some of it, by its number.
_FRAME = ["CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM", "Độc lập - Tự do - Hạnh phúc", "Số: 12/QĐ", "số: 12", " Trang 3 / 10 ", "Trang ba", "Huế, ngày 1 tháng 2 năm 2024", "Chương I Chung", "Điều 1. Phạm vi", "Điều kiện", "Điều kiện", "khoản 2: thời hạn", "a) bản sao", "a) bản sao", "a) bản sao", "Điều kiện", "page 7"]
_TOP = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN (doc_id + {i}) % 3 > 0 THEN '{x}' END" for i, x in enumerate(_FRAME)) + "], lambda x: x IS NOT NULL), chr(10))"
_HEAD = "(" + " OR ".join(f"regexp_matches(line, '(?i){p}')" for p in rules.LEGAL_HEADING) + ")"
_PAGES = f"(regexp_matches(line, '(?i){rules.PAGE}') OR regexp_matches(line, '{rules.NUMBER}') OR regexp_matches(line, '(?i){rules.PLACE_DATE}') OR " + " OR ".join(f"contains(upper(line), '{m}')" for m in rules.MOTTO) + ")"
_MARK = "CASE " + " ".join(f"WHEN regexp_matches(line, '(?i){p}') THEN '{x}' || line || '{y}'" for p, x, y in rules.LEGAL) + " ELSE line END"


@query(f"""WITH l AS (SELECT doc_id, i, trim(parts[i], chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM (SELECT doc_id, string_split({_TOP} || chr(10) || text, chr(10)) AS parts FROM documents), unnest(generate_series(1, len(parts))) AS u(i)),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, line) AS n, {_HEAD} AS head FROM l WHERE line <> ''),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS nth FROM c WHERE NOT {_PAGES} AND (n < 3 OR head))
SELECT d.doc_id, md5(coalesce(string_agg(CASE WHEN head AND nth > 1 THEN chr(10) ELSE '' END || {_MARK}, chr(10) ORDER BY i), '')) AS digest, coalesce(bool_or(head), false) AS legal FROM documents d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id""")
def boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL14, FN4: documents below the lines of a legal page, cleaned and written as Markdown."""
    frame = F.array_join(F.array_compact(F.array(*[F.when((F.col("doc_id") + i) % 3 > 0, F.lit(x)) for i, x in enumerate(_FRAME)])), "\n")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(frame, F.lit("\n"), "text").alias("text"))
    return chunking.without_boilerplate(d).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "legal")


@query(r"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, '. ', chr(10) || ' ' || chr(10)), '\n\s*\n'), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') AS ps FROM documents)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, ps[i] AS paragraph FROM p, unnest(generate_series(1, len(ps))) AS u(i)""")
def paragraph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF4: texts whose sentences are parted by blank lines, with white space in them, cut there."""
    return chunking.paragraphs(table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(". "), F.lit("\n \n")).alias("text")))


@query("""WITH t AS (SELECT conv_id, turn, CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS id FROM conversations)
SELECT id, coalesce(lag(id) OVER w, '') AS prev_chunk_id, coalesce(lead(id) OVER w, '') AS next_chunk_id FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def prev_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN5, JN8, TF3."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("id"))
    return chunking.linked(t, "conv_id", "turn").select("id", "prev_chunk_id", "next_chunk_id")


_SPANS = """l AS (SELECT conv_id AS doc_id, turn AS pos, length(text) AS n, CASE WHEN turn % 3 = 1 THEN turn * 10 END AS o FROM conversations),
s AS (SELECT doc_id, pos, n, coalesce(o, sum(CASE WHEN o IS NULL THEN n ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l)"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    rows = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.col("text").alias("line"), F.when(F.col("turn") % 3 == 1, F.col("turn") * 10).alias("offset"))
    return chunking.spans(rows)


@query(f"WITH {_SPANS} SELECT doc_id, pos, CAST(start AS BIGINT) AS start, CAST(start + n AS BIGINT) AS end_ FROM s")
def span_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN6."""
    return _spans(spark, sf_dir).select("doc_id", "pos", "start", "end_")


@query(f"""WITH {_SPANS}, p AS (SELECT DISTINCT doc_id, u.i AS place, pos % 2 AS side FROM s, range(CAST(start AS BIGINT), CAST(start + n AS BIGINT)) AS u(i)),
g AS (SELECT doc_id, place, count(*) AS k FROM p GROUP BY ALL) SELECT doc_id, round(count(*) FILTER (k = 2) / count(*), 9) AS iou FROM g GROUP BY doc_id""")
def span_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG47."""
    s = _spans(spark, sf_dir).select("doc_id", "pos", "start", "end_")
    return chunking.iou(s.filter("pos % 2 = 0"), s.filter("pos % 2 = 1"), "doc_id").select("doc_id", F.round("iou", 9).alias("iou"))


@query("""WITH e AS (SELECT user_id, ts, event_id, value < 40 AS low FROM events),
i AS (SELECT *, sum(CAST(NOT low AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM e)
SELECT event_id, CASE WHEN low THEN CAST(sum(CAST(low AS INTEGER)) OVER w AS BIGINT) ELSE 0 END AS streak, CASE WHEN low THEN sum(CAST(low AS INTEGER)) OVER w ELSE 0 END >= 3 AS escalate
FROM i WINDOW w AS (PARTITION BY user_id, island ORDER BY ts, event_id)""")
def escalation_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN7, STM7."""
    e = table(spark, sf_dir, "events")
    return chunking.streaks(e, F.col("value") < 40, ["ts", "event_id"], "user_id").select("event_id", "streak", "escalate")


@query("""WITH c AS (SELECT CASE WHEN turn % 5 <> 0 THEN conv_id END AS id, turn - 1 AS chunk_id, text, CASE WHEN role <> 'system' THEN role END AS source FROM conversations)
SELECT count(*) AS total, count(*) FILTER (id IS NOT NULL AND chunk_id >= 0 AND length(text) >= 10 AND source IS NOT NULL) AS valid, count(*) FILTER (length(text) < 10) AS short_text FROM c""")
def validate_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL16."""
    c = table(spark, sf_dir, "conversations").select(
        F.when(F.col("turn") % 5 != 0, F.col("conv_id")).alias("id"), F.col("conv_id").alias("doc_id"), (F.col("turn") - 1).alias("chunk_id"), "text", F.when(F.col("role") != "system", F.col("role")).alias("source")
    )
    v = chunking.validated(c)
    return v.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.size("errors") == 0).alias("valid"), F.count_if(F.array_contains("errors", "text")).alias("short_text"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(text)")
def dedup_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies of texts, by digest."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256)).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).select("doc_id", "copies")


def documents_with_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with what an ingest knows of them: every fourth an answer, every third one a legal page, with headings inside."""
    i = F.col("doc_id")
    frame = F.array_join(F.array_compact(F.array(*[F.when((i + k) % 3 > 0, F.lit(x)) for k, x in enumerate(_FRAME)])), "\n")
    text = F.when(i % 3 == 0, F.concat(frame, F.lit("\n"), F.replace("text", F.lit(". "), F.concat(F.lit(".\nĐiều "), i.cast("string"), F.lit(". "))))).otherwise(F.col("text"))
    faq = F.when(i % 4 == 1, F.lit("overview"))
    meta = F.map_filter(F.create_map(F.lit("source"), F.col("source"), F.lit("faq_type"), faq, F.lit("info_type"), F.when(i % 5 == 2, F.lit("school_policy"))), lambda k, v: v.isNotNull())
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), F.lit(None).cast("string").alias("text_plain"), F.when(i % 8 == 1, F.substring("text", 1, 200)).alias("summary"), meta.alias("metadata"))


@query()
def chunk_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF1-TF3, FIL20, WN9: chunk rows of every document by its own profile."""
    return profiles.chunked(documents_with_metadata(spark, sf_dir))


@query(r"""SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'faq' WHEN doc_id % 5 = 2 OR doc_id % 3 = 0 THEN 'policy' ELSE 'auto' END AS profile FROM documents""")
def profile_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF2: by metadata, then by headings."""
    return documents_with_metadata(spark, sf_dir).select("doc_id", profiles.profile_of(F.col("metadata"), F.col("text")).alias("profile"))


@query()
def table_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN24: answers with a table of two turns of a conversation in them, whose rows are whole, short, long or without a rule."""
    t, i = F.col("text"), F.col("conv_id") + F.col("turn")
    words = F.slice(F.split(t, " "), F.lit(1), F.lit(6))
    row = lambda n: F.concat(F.lit("| "), F.array_join(F.slice(words, F.lit(1), n), " | "), F.lit(" |"))
    rule = F.when(i % 4 > 0, F.lit("|---|:--|---|\n")).otherwise(F.lit(""))
    answer = F.concat(t, F.lit("\n"), row(F.lit(3)), F.lit("\n"), rule, row((1 + i % 5).cast("int")), F.lit("\n"), row(F.lit(3)), F.lit("\nend"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", answer.alias("answer"), tables.repaired(answer).alias("repaired"))


@query("SELECT conv_id, turn, length(text) AS n, md5(text) AS digest FROM conversations")
def answer_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM9, TF7: pieces of at most 40 characters; joined again, they must be the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(c, t, i, p) for c, t, x in zip(b["conv_id"], b["turn"], b["text"], strict=True) for i, p in enumerate(chunking.pieces(x))]
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "i", "piece"])

    cut = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").mapInPandas(run, "conv_id long, turn long, i int, piece string")
    whole = cut.groupBy("conv_id", "turn").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "piece"))), lambda p: p["piece"]), "").alias("t"))
    return whole.select("conv_id", "turn", F.length("t").cast("long").alias("n"), F.md5(F.col("t").cast("binary")).alias("digest"))


@query("""SELECT page_id, u.row_no, CASE u.row_no WHEN 1 THEN [CAST(page_id AS VARCHAR) || ' ' || CAST(length(url) AS VARCHAR), url || ' 7,5'] ELSE ['a b', 'x 16'] END AS cells
FROM pages, (VALUES (CAST(1 AS INTEGER)), (CAST(2 AS INTEGER))) AS u(row_no)""")
def html_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC8, TF6: rows of a score table put in front of each page; breaks and paragraphs separate words of a cell."""
    cell = lambda *parts: F.concat(F.lit("<td>"), *parts, F.lit("</td>"))
    own = F.concat(
        F.lit("<table><thead><tr><th>Name</th></tr></thead><tr>"),
        cell(F.col("page_id").cast("string"), F.lit("<br>"), F.length("url").cast("string")),
        cell(F.lit("<p>"), F.col("url"), F.lit("</p><p> 7,5 </p>")),
        F.lit("</tr><tr><td>a<b>b</b></td><td>x<span>16</span></td></tr></table>"),
    )
    return html.table_rows(table(spark, sf_dir, "pages").select("page_id", F.concat(own, "html").alias("html")))


@query()
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC7, SRC9."""
    return html.visible_text(table(spark, sf_dir, "pages"))


@query("""WITH o AS (SELECT page_id, sha256(html) AS h FROM pages WHERE page_id % 6 <> 0), n AS (SELECT page_id, sha256(CASE WHEN page_id % 4 = 0 THEN html || ' ' ELSE html END) AS h FROM pages WHERE page_id % 9 <> 0)
SELECT page_id, CASE WHEN o.h IS NULL THEN 'fetched' WHEN n.h IS NULL THEN 'failed' WHEN o.h = n.h THEN 'unchanged' ELSE 'replaced' END AS status FROM o FULL JOIN n USING (page_id)""")
def page_change_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC9: what a crawl found against what was there."""
    p = table(spark, sf_dir, "pages")
    o = p.filter("page_id % 6 <> 0").select("page_id", F.sha2("html", 256).alias("o"))
    n = p.filter("page_id % 9 <> 0").select("page_id", F.sha2(F.when(F.col("page_id") % 4 == 0, F.concat("html", F.lit(" "))).otherwise(F.col("html")), 256).alias("n"))
    status = F.when(F.col("o").isNull(), "fetched").when(F.col("n").isNull(), "failed").when(F.col("o") == F.col("n"), "unchanged").otherwise("replaced")
    return o.join(n, "page_id", "full").select("page_id", status.alias("status"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times as instants, as watermarks need them; the session's zone must be UTC for them to mean the same."""
    return windows.read(spark, sf_dir, "events", table(spark, sf_dir, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(df: DataFrame, *times: str) -> DataFrame:
    return df.withColumns({t: F.col(t).cast("timestamp_ntz") for t in times})


@query("SELECT time_bucket(INTERVAL 1 day, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: tumbling windows over a stream, equal to the batch."""
    out = windows.drain(windows.windowed(_stream(spark, sf_dir), "1 day"), "stream_tumbling", "complete")
    return _plain(out.withColumn("total", F.round("total", 6)), "start")


@query("""WITH w AS (SELECT time_bucket(INTERVAL 12 hours, ts) - INTERVAL 12 hours * k AS start, event_type, value FROM events, range(0, 2) AS r(k))
SELECT start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM w GROUP BY ALL""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: windows of a day that slide by half a day."""
    out = windows.drain(windows.windowed(_stream(spark, sf_dir), "1 day", "12 hours"), "stream_sliding", "complete")
    return _plain(out.withColumn("total", F.round("total", 6)), "start")


@query("""WITH g AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 3 hours, true) AS new FROM events),
s AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL 3 hours AS end_, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: sessions that three quiet hours end."""
    return _plain(windows.drain(windows.sessions(_stream(spark, sf_dir), "3 hours"), "stream_session", "complete"), "start", "end_")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM1: rows that a stream gives twice are dropped within the watermark."""
    s = _stream(spark, sf_dir)
    twice = s.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).drop("k")
    return windows.drain(windows.first_in(twice, "event_id"), "stream_dedup").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query()
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM3, WN11: at most three accepted requests of a user in six hours."""
    return windows.drain(windows.rate_limited(_stream(spark, sf_dir).select("user_id", "ts", "event_id"), 3, 6 * 3600.0), "rate_limit")
