"""Queries of filters, temporal rules, text rules, routing, the recommender and table maintenance."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import filters, matching
from lodestone.plans.registry import query, table

NOW = 1996


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'fr' AND source = 'src3'")
def metadata_filter_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL1, FIL2: the conditions reach the scan."""
    return filters.metadata_filter(table(spark, sf_dir, "documents"), {"lang": "fr", "source": "src3"}).select("doc_id", "lang", "source")


@query("SELECT doc_id, lang, source FROM documents WHERE (lang = 'fr' AND source = 'src3') OR (lang = 'de')")
def metadata_filter_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL1: or_conditions make the top-level keys moot."""
    where = {"lang": "xx", "or_conditions": [{"lang": "fr", "source": "src3"}, {"lang": "de"}]}
    return filters.metadata_filter(table(spark, sf_dir, "documents"), where).select("doc_id", "lang", "source")


@query("SELECT doc_id, lang FROM documents")
def filter_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL12: nothing passes, so everything does."""
    return filters.with_fallback(table(spark, sf_dir, "documents").select("doc_id", "lang"), F.col("lang") == "xx")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("distance"), (F.col("o_orderkey") % 11 == 0).alias("superseded"))


_ORD = "o AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice AS distance, o_orderkey % 11 = 0 AS superseded FROM orders)"


@query(f"WITH {_ORD}, d AS (SELECT o_orderkey, CASE WHEN year = 1993 THEN distance WHEN year = {NOW} AND distance > 0 THEN distance / 1.5 WHEN year < {NOW} THEN distance / 0.7 ELSE distance END AS d FROM o) SELECT o_orderkey, round(d, 6) AS d FROM d")
def temporal_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL5."""
    d = filters.temporal_distance(F.col("distance"), F.col("year"), NOW, 1993)
    return _orders(spark, sf_dir).select("o_orderkey", F.round(d, 6).alias("d"))


@query(f"WITH {_ORD} SELECT o_orderkey, year FROM o WHERE year >= {NOW}")
def temporal_hard_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL3."""
    return filters.temporal_exclude(_orders(spark, sf_dir), F.col("year"), NOW, True, True, "ambiguous").select("o_orderkey", "year")


@query(f"WITH {_ORD} SELECT o_orderkey FROM o WHERE NOT superseded")
def superseded_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL4."""
    return filters.not_superseded(_orders(spark, sf_dir), F.col("superseded"), F.lit(False)).select("o_orderkey")


@query(f"WITH {_ORD} SELECT o_orderkey, year, superseded OR year < {NOW} AS superseded FROM o")
def supersede_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK12."""
    return filters.supersede(_orders(spark, sf_dir), "year", "superseded", NOW).select("o_orderkey", "year", "superseded")


_RULES = [(0, "thon", "5"), (1, "idiot|scum", "9"), (1, "trash", "12"), (2, "un|une", "5"), (3, "queen|zz", "77"), (4, "ch$", "123456789")]
_RSQL = "r(ord, pattern, chunk_id) AS (VALUES " + ", ".join(f"({o}, '{p}', '{c}')" for o, p, c in _RULES) + ")"


@query(f"WITH {_RSQL} SELECT conv_id, turn, chunk_id, min(ord) AS ord FROM conversations, r WHERE regexp_matches(text, pattern) GROUP BY ALL")
def booster_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN10: texts against a table of patterns."""
    rules = spark.createDataFrame(_RULES, "ord int, pattern string, chunk_id string")
    c = table(spark, sf_dir, "conversations")
    return filters.rules_fired(c, rules, ["conv_id", "turn"], "text")


_LONG_WORDS = r"SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS w FROM benchmark"


@query(f"""WITH w AS ({_LONG_WORDS}), r AS (SELECT md5(w) AS id, w, w AS literal, '' AS rest FROM w WHERE length(w) % 2 = 0 UNION ALL SELECT md5(w), w, left(w, 4), 's?,? ' FROM w WHERE length(w) % 2 = 1)
SELECT conv_id, turn, count(*) AS fired, min(id) AS first FROM conversations, r WHERE CASE WHEN rest = '' THEN contains(text, literal) ELSE regexp_matches(text, literal || rest) END GROUP BY ALL""")
def rule_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN10: a rule for each longer word of the benchmark, half of them patterns, over all turns in one scan."""
    w = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))).alias("w")).distinct()
    pattern = F.when(F.length("w") % 2 == 0, F.col("w")).otherwise(F.concat(F.substring("w", 1, 4), F.lit("s?,? ")))
    rules = w.select(F.xxhash64("w").alias("ord"), F.md5(F.col("w").cast("binary")).alias("id"), pattern.alias("pattern"))
    hits = matching.fired(table(spark, sf_dir, "conversations"), rules, ["conv_id", "turn"], "text").join(rules.select("ord", "id"), "ord")
    return hits.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("fired"), F.min("id").alias("first"))


@query(f"WITH {_RSQL} SELECT chunk_id, min(ord) AS ord FROM r WHERE chunk_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents) GROUP BY chunk_id")
def rule_chunk_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM10: rules whose chunk doesn't exist."""
    rules = spark.createDataFrame(_RULES, "ord int, pattern string, chunk_id string").groupBy("chunk_id").agg(F.min("ord").alias("ord"))
    return rules.join(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id")), "chunk_id", "left_anti")


_PII = "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in T.PII_WORDS) + rf" OR regexp_matches(text, '{T.EMAIL}') OR regexp_matches(text, '{T.PHONE}') OR regexp_matches(text, '{T.CITIZEN}'))"


@query(f"SELECT doc_id, {_PII} AS pii FROM documents")
def pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL21."""
    return table(spark, sf_dir, "documents").select("doc_id", T.has_pii(F.col("text")).alias("pii"))


_SCOPE = r"""p AS (SELECT conv_id, turn, array_to_string(regexp_extract_all(lower(text), '[a-z]+')[1:1 + conv_id % 2], ' ') AS phrase FROM conversations),
a AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark WHERE item_id % 2 = 0),
d AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM benchmark WHERE item_id % 5 = 1)"""


@query(f"""WITH {_SCOPE}, q AS (SELECT DISTINCT phrase FROM p WHERE phrase <> ''),
x AS (SELECT DISTINCT phrase FROM q, a WHERE phrase = word OR (length(word) >= 3 AND (contains(phrase, word) OR contains(word, phrase)) AND NOT (length(word) < 4 AND length(phrase) < 4))),
y AS (SELECT DISTINCT phrase FROM q, d WHERE contains(phrase, word))
SELECT conv_id, turn, phrase, phrase IN (FROM x) AS allowed, phrase IN (FROM y) AS denied FROM p""")
def scope_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL22, JN16: phrases against a list either way (words of three letters or more, not both under four), and against a list of refusals one way."""
    found = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    p = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.slice(found, F.lit(1), (1 + F.col("conv_id") % 2).cast("int")), " ").alias("phrase"))
    words = lambda least, keep: table(spark, sf_dir, "benchmark").filter(keep).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"[a-z]{{{least},}}"), F.lit(0))).alias("word")).distinct()
    allowed = matching.either_way(p, words(1, "item_id % 2 = 0")).withColumn("allowed", F.lit(True))
    refused = words(4, "item_id % 5 = 1").select(F.xxhash64("word").alias("ord"), F.col("word").alias("pattern"))
    denied = matching.fired(p.select("phrase").distinct(), refused, ["phrase"], "phrase").select("phrase").distinct().withColumn("denied", F.lit(True))
    return p.join(allowed, "phrase", "left").join(denied, "phrase", "left").select("conv_id", "turn", "phrase", F.coalesce("allowed", F.lit(False)).alias("allowed"), F.coalesce("denied", F.lit(False)).alias("denied"))


_PHRASES = ["Học phí năm nay là?", "Điểm chuẩn 2024 và 2031 ngành CNTT", "so sánh học phí qua các năm", "chỉ tiêu năm ngoái", "xin chào", "đối chiếu điểm 2025", "năm nayx", "theo nămm 2019", "tổ hợp xét tuyển sang năm", "mã 7480201 năm 1999"]
_PSQL = "p AS (SELECT conv_id * 1000 + turn AS id, ([" + ", ".join(f"'{t}'" for t in _PHRASES) + f"])[1 + (conv_id + turn) % {len(_PHRASES)}] || ' ' || text AS text FROM conversations)"


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns, each behind one of the phrases."""
    phrase = F.get(F.array(*map(F.lit, _PHRASES)), ((F.col("conv_id") + F.col("turn")) % len(_PHRASES)).cast("int"))
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(phrase, F.lit(" "), "text").alias("text"))


_CASE = " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{label}'" for label, p in T.INTENTS)


@query(f"WITH {_PSQL} SELECT id, CASE {_CASE} END AS intent FROM p")
def intent_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN16."""
    return _phrases(spark, sf_dir).select("id", T.first_match(F.col("text")).alias("intent"))


@query(rf"WITH {_PSQL} SELECT id, list_transform(regexp_extract_all(text, '\b(199\d|20[0-3]\d)\b', 1), lambda y: CAST(y AS INTEGER)) AS years FROM p")
def year_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN13."""
    return _phrases(spark, sf_dir).select("id", T.years("text").alias("years"))


@query(rf"""WITH {_PSQL}, y AS (SELECT *, CAST(nullif(regexp_extract(text, '\b(199\d|20[0-3]\d)\b', 1), '') AS INTEGER) AS y FROM p)
SELECT id, CASE WHEN regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}_])(so\s+sánh|đối\s+chiếu|qua\s+các\s+năm|từng\s+năm|theo\s+năm|giữa\s+các\s+năm)($|[^\p{{L}}\p{{N}}_])') THEN 'cross_year' WHEN regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}_])(năm\s+nay|hiện\s+tại|năm\s+hiện\s+tại|hiện\s+nay)($|[^\p{{L}}\p{{N}}_])') THEN 'current' WHEN regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}_])(năm\s+trước|năm\s+ngoái|năm\s+cũ|năm\s+rồi)($|[^\p{{L}}\p{{N}}_])') THEN 'historical' WHEN y >= 2026 THEN 'current' WHEN y < 2026 THEN 'historical' ELSE 'ambiguous' END AS intent FROM y""")
def temporal_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN15."""
    return _phrases(spark, sf_dir).select("id", T.temporal_intent(F.col("text"), 2026).alias("intent"))


_REL = "text"
for _p, _o in T.RELATIVE:
    _REL = f"regexp_replace({_REL}, '(?i){_p}', 'năm {2026 + _o}', 'g')"


@query(rf"WITH {_PSQL} SELECT id, CASE WHEN regexp_matches(text, '\b20[2-3][0-9]\b') THEN text ELSE {_REL} END AS text FROM p")
def year_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN14."""
    return _phrases(spark, sf_dir).select("id", T.with_years(F.col("text"), 2026).alias("text"))


@query(r"""WITH c AS (SELECT conv_id, turn, text, len(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS n FROM conversations),
t AS (SELECT *, CASE WHEN contains(lower(text), 'thonre') THEN 'admission_criteria' WHEN contains(lower(text), 'ing in') THEN 'documents' WHEN contains(lower(text), 'was') THEN 'scoring' ELSE 'general' END AS kind FROM c)
SELECT conv_id, turn, kind, CAST(CASE WHEN kind = 'general' OR n > 15 THEN 7 WHEN kind IN ('admission_criteria', 'documents') THEN 5 ELSE 3 END AS INTEGER) AS top_k FROM t""")
def query_type_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN29: a type by keywords and a limit by type and length."""
    low = F.lower("text")
    kind = F.when(F.contains(low, F.lit("thonre")), "admission_criteria").when(F.contains(low, F.lit("ing in")), "documents").when(F.contains(low, F.lit("was")), "scoring").otherwise("general")
    n = F.size(F.filter(F.split(low, r"\s+"), lambda w: w != ""))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", kind.alias("kind"), n.alias("n"))
    k = F.when((F.col("kind") == "general") | (F.col("n") > 15), 7).when(F.col("kind").isin("admission_criteria", "documents"), 5).otherwise(3)
    return c.select("conv_id", "turn", "kind", k.alias("top_k"))


@query(r"""WITH c AS (SELECT conv_id, turn, text, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n, 1 + conv_id % 4 AS complexity, CASE conv_id % 3 WHEN 0 THEN 'padded' WHEN 1 THEN 'hybrid' ELSE 'graph' END AS cls, len(list_distinct(regexp_extract_all(text, 'th[a-z]+re', 0))) AS entities FROM conversations)
SELECT conv_id, turn, CASE WHEN n <= 3 THEN 'reject' WHEN regexp_matches(text, '^In') THEN 'contact' WHEN regexp_matches(text, '(?i)\bhere\b|thandin') THEN 'graph' WHEN cls <> 'padded' THEN cls WHEN complexity >= 2 THEN 'hybrid' WHEN entities >= 2 THEN 'hybrid' ELSE 'padded' END AS route FROM c""")
def route_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN33: vague, contact, listing or comparison, then the classifier's route with its bump and its demotion."""
    t = F.col("text")
    n = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    cls = F.when(F.col("conv_id") % 3 == 0, "padded").when(F.col("conv_id") % 3 == 1, "hybrid").otherwise("graph")
    entities = F.size(F.array_distinct(F.regexp_extract_all(t, F.lit("th[a-z]+re"), F.lit(0))))
    route = (
        F.when(n <= 3, "reject")
        .when(t.rlike("^In"), "contact")
        .when(t.rlike(r"(?i)\bhere\b|thandin"), "graph")
        .when(cls != "padded", cls)
        .when((1 + F.col("conv_id") % 4 >= 2) | (entities >= 2), "hybrid")
        .otherwise("padded")
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", route.alias("route"))


@query("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INTEGER) AS back FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4")
def last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN10."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(w).alias("back")).filter("back <= 4")


@query(r"WITH k AS (SELECT conv_id, turn, sha256(regexp_replace(lower(trim(text)), '\s+', ' ', 'g'))[1:16] AS k FROM conversations) SELECT conv_id, turn, row_number() OVER (PARTITION BY k ORDER BY conv_id, turn) > 1 AS hit FROM k")
def router_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM2 without eviction: a key seen before is a hit."""
    k = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.cache_key(F.col("text")).alias("k"))
    first = k.groupBy("k").agg(F.min(F.struct("conv_id", "turn")).alias("f"))
    return k.join(first, "k").select("conv_id", "turn", (F.struct("conv_id", "turn") != F.col("f")).alias("hit"))


@query("""WITH h AS (SELECT p_brand AS code, p_type AS name, 1990 + p_partkey % 8 AS year, 15 + p_size / 4.0 AS score, p_partkey FROM part),
l AS (SELECT code, arg_max(score, (year, -p_partkey)) AS score, max(year) AS year FROM h GROUP BY code),
d AS (SELECT code, year, round(21.5 + 0.5 - score, 6) AS delta FROM l)
SELECT code, year, delta, CASE WHEN delta >= 2 THEN 'an_toan' WHEN delta >= -1 THEN 'can_nhac' ELSE 'mao_hiem' END AS label, CAST(row_number() OVER (ORDER BY delta DESC, code) AS INTEGER) AS place FROM d""")
def recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN14, FN19, TK5: the latest score per code against one's own."""
    d = _latest(spark, sf_dir).withColumn("delta", F.round(F.lit(21.5) + 0.5 - F.col("score"), 6))
    place = F.row_number().over(Window.orderBy(F.desc("delta"), "code"))  # one row per code: a short list
    return d.select("code", "year", "delta", T.recommendation(F.col("delta")).alias("label"), place.alias("place"))


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "part").select(F.col("p_brand").alias("code"), (1990 + F.col("p_partkey") % 8).alias("year"), (15 + F.col("p_size") / 4.0).alias("score"), (-F.col("p_partkey")).alias("o"))
    return filters.latest(h.withColumn("o", -F.col("o")), ["code"], "year", ["o"]).select("code", "score", "year")


@query("""WITH h AS (SELECT p_brand AS code, 1990 + p_partkey % 8 AS year, 15 + p_size / 4.0 AS score, p_partkey FROM part)
SELECT code, CAST(arg_max(score, (year, -p_partkey)) AS DOUBLE) AS score, max(year) AS year FROM h GROUP BY code""")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN14."""
    return _latest(spark, sf_dir)


@query("""SELECT p_partkey, CASE WHEN 22 - p_size / 2.0 >= 3 THEN 'rất cao' WHEN 22 - p_size / 2.0 >= 1 THEN 'cao' WHEN 22 - p_size / 2.0 >= -1 THEN 'trung bình' ELSE 'thấp' END AS band FROM part""")
def whatif_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN19."""
    return table(spark, sf_dir, "part").select("p_partkey", T.band(22 - F.col("p_size") / 2.0).alias("band"))


@query("SELECT p_brand, p_size, min(p_partkey) AS p_partkey FROM part GROUP BY p_brand, p_size")
def first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN8."""
    return filters.first_wins(table(spark, sf_dir, "part").select("p_brand", "p_size", "p_partkey"), ["p_brand", "p_size"], ["p_partkey"])


@query(r"""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 10 = 1 THEN 'x1' ELSE CAST(7480000 + p_partkey % 50 AS VARCHAR) END AS code FROM part)
SELECT p_partkey, code, coalesce(regexp_matches(code, '^7[0-9]{6}([A-Z]{2})?$'), false) AS well_formed, code IS NULL OR code IN (SELECT CAST(7480000 + i * 3 AS VARCHAR) FROM range(0, 12) AS t(i)) AS kept FROM p""")
def code_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL10, FIL18, JN13: rows without a code stay, the rest must be on the list."""
    k = F.col("p_partkey")
    code = F.when(k % 10 == 0, None).when(k % 10 == 1, "x1").otherwise((7480000 + k % 50).cast("string"))
    listed = spark.range(12).select((7480000 + F.col("id") * 3).cast("string").alias("code"), F.lit(True).alias("ok"))
    p = table(spark, sf_dir, "part").select("p_partkey", code.alias("code")).join(listed, "code", "left")
    return p.select("p_partkey", "code", F.coalesce(F.col("code").rlike("^7[0-9]{6}([A-Z]{2})?$"), F.lit(False)).alias("well_formed"), (F.col("code").isNull() | F.coalesce("ok", F.lit(False))).alias("kept"))


_MAN = "a AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 0)"


@query(f"WITH {_MAN} SELECT doc_id, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' WHEN a.h = b.h THEN 'unchanged' ELSE 'replaced' END AS status FROM a FULL JOIN b USING (doc_id)")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK3, SRC9: two manifests of digests compared."""
    d = table(spark, sf_dir, "documents")
    old = d.filter("doc_id % 7 <> 0").select("doc_id", F.sha2("text", 256).alias("h"))
    new = d.filter("doc_id % 11 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("h"))
    return filters.manifest_diff(old, new, "doc_id", "h")


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 <> 0")
def incremental_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN12: only unseen ids."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return filters.append_new(d.filter("doc_id % 2 = 0"), d.filter("doc_id % 3 = 0").unionAll(d.filter("doc_id % 9 = 0")), "doc_id")


@query("SELECT p_brand, 'added' AS side FROM (SELECT p_brand FROM part WHERE p_size > 48 EXCEPT SELECT p_brand FROM part WHERE p_size < 3) UNION ALL SELECT p_brand, 'removed' FROM (SELECT p_brand FROM part WHERE p_size < 3 EXCEPT SELECT p_brand FROM part WHERE p_size > 48)")
def set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN18, ST-E2."""
    p = table(spark, sf_dir, "part")
    new, old = p.filter("p_size > 48").select("p_brand").distinct(), p.filter("p_size < 3").select("p_brand").distinct()
    return new.join(old, "p_brand", "left_anti").withColumn("side", F.lit("added")).unionAll(old.join(new, "p_brand", "left_anti").withColumn("side", F.lit("removed")))


@query(r"SELECT doc_id, coalesce(nullif(trim(regexp_replace(lower(substr(text, 1, 40)), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'doc') AS slug, coalesce(nullif(trim(regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'doc') || '_' || sha1(source || '/' || CAST(doc_id AS VARCHAR))[1:8] AS stable_id FROM documents")
def slug_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN1, FN2: names come from a title, as in the reference, not from whole texts."""
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", T.slug(F.substring("text", 1, 40)).alias("slug"), T.stable_id(F.col("source"), path).alias("stable_id"))


@query(rf"WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda w: len(w) > 2 AND w NOT IN ('và', 'các', 'của', 'có', 'được', 'cho', 'trong', 'là', 'một', 'này', 'để', 'với', 'theo', 'từ', 'đã', 'sẽ', 'không', 'khi', 'bằng')) AS ws FROM documents) SELECT doc_id, CAST(len(ws) AS INTEGER) AS n, ws[1] AS first_term, md5(array_to_string(ws, ' ')) AS digest FROM t")
def sparse_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN8."""
    t = table(spark, sf_dir, "documents").select("doc_id", T.sparse_terms(F.col("text")).alias("ws"))
    return t.select("doc_id", F.size("ws").alias("n"), F.get("ws", F.lit(0)).alias("first_term"), F.md5(F.array_join("ws", " ").cast("binary")).alias("digest"))


#: Vietnamese phrases, with what the rules make of them written out: composed and doubly accented letters, đ, and marks.
_ACCENTS = [
    ("điểm chuẩn ngành tuyển sinh", "diểm chuẩn nganh tuyển sinh", "điem chuan nganh tuyen sinh"),
    ("  Học phí NĂM nay: bao nhiêu? ", "  hoc phi nam nay: bao nhieu? ", "hoc phi nam nay: bao nhieu?"),
    ("Đại học Khoa học (Huế)", "dai hoc khoa hoc (huế)", "đai hoc khoa hoc (hue)"),
    ("Süßes Café, ½ naïve", "süßes cafe, ½ naïve", "sußes cafe, 1⁄2 naive"),
]


@query(r"""SELECT doc_id, md5(translate(lower(text), 'ăâáàảãạêéèẻẽẹôơóòỏõọưúùủũụíìỉĩịđýỳỷỹỵ', 'aaaaaaaeeeeeeooooooouuuuuuiiiiidyyyyy')) AS folded FROM documents
UNION ALL SELECT * FROM (VALUES """ + ", ".join(f"({-1 - i}, md5('{ten}'))" for i, (_, ten, _) in enumerate(_ACCENTS)) + ") AS p(doc_id, folded)")
def unaccent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN10: a fixed map of letters, which misses doubly accented ones."""
    own = spark.createDataFrame([(-1 - i, t) for i, (t, _, _) in enumerate(_ACCENTS)], "doc_id long, text string")
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").unionAll(own)
    return rows.select("doc_id", F.md5(T.unaccent("text").cast("binary")).alias("folded"))


@query("SELECT item_id, trim(lower(strip_accents(text)), chr(32) || chr(9) || chr(10) || chr(13)) AS folded FROM benchmark UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-1 - i}, '{nine}')" for i, (_, _, nine) in enumerate(_ACCENTS)) + ") AS p(item_id, folded)")
def fold_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN9: all combining marks go, whatever the letter; đ stays."""
    own = spark.createDataFrame([(-1 - i, t) for i, (t, _, _) in enumerate(_ACCENTS)], "item_id long, text string")
    return table(spark, sf_dir, "benchmark").select("item_id", "text").unionAll(own).select("item_id", T.fold("text").alias("folded"))


_LOWER = "lower(text)"
for _c in map(chr, range(0xE0, 0x100)):  # DuckDB can't decompose: the letters of the tables' languages, one by one
    if _d := unicodedata.decomposition(_c):
        _LOWER = f"replace({_LOWER}, '{_c}', {' || '.join(f'chr({int(x, 16)})' for x in _d.split())})"


@query(rf"""SELECT item_id, regexp_replace(regexp_replace(trim({_LOWER}, chr(32) || chr(9) || chr(10) || chr(13)), '\s+', ' ', 'g'), '[.,;:!?()\[\]{{}}"''_-]', '', 'g') AS answer FROM benchmark
UNION ALL SELECT -1, 'bao nhie' || chr(770) || 'u' UNION ALL SELECT -2, 'ma nganh 7480201'""")
def normalize_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN11, FN12: letters are decomposed, and keep their marks."""
    own = spark.createDataFrame([(-1, " Bao  NHIÊU?"), (-2, "ma_ nganh\n(7480201)")], "item_id long, text string")
    return table(spark, sf_dir, "benchmark").select("item_id", "text").unionAll(own).select("item_id", T.normal_answer("text").alias("answer"))
