"""Queries about answers and their sources: abstention, grounding, parsing, labels, redaction and set logic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import profiles
from lodestone.plans.registry import query, table
from lodestone.plans.texts import documents_with_metadata

_A = """a AS (SELECT conv_id, turn, text, CASE conv_id % 4 WHEN 0 THEN 'refuse' WHEN 1 THEN 'abstain' ELSE 'answer' END AS expected,
  text = '' OR length(text) < 80 OR regexp_matches(substr(lower(text), 1, 240), 'thonre|hend in') AS abstained FROM conversations WHERE role = 'assistant')"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN26-28: an answer abstains if it is short or empty, or its first 240 characters hold one of the phrases."""
    t = F.col("text")
    gone = (t == "") | (F.length(t) < 80) | F.substring(F.lower(t), 1, 240).rlike("thonre|hend in")
    expected = F.when(F.col("conv_id") % 4 == 0, "refuse").when(F.col("conv_id") % 4 == 1, "abstain").otherwise("answer")
    return table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", "text", expected.alias("expected"), gone.alias("abstained"))


@query(f"WITH {_A} SELECT conv_id, turn, abstained FROM a")
def abstain_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN26-28."""
    return _answers(spark, sf_dir).select("conv_id", "turn", "abstained")


@query(f"WITH {_A} SELECT expected, count(*) AS n, round(avg(CAST(abstained AS INTEGER)), 9) AS abstain_rate, round(avg(CAST(NOT abstained AS INTEGER)), 9) AS answer_rate FROM a GROUP BY expected")
def abstain_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG30."""
    rate = lambda c: F.round(F.avg(c.cast("int")), 9)
    return _answers(spark, sf_dir).groupBy("expected").agg(F.count(F.lit(1)).alias("n"), rate(F.col("abstained")).alias("abstain_rate"), rate(~F.col("abstained")).alias("answer_rate"))


@query(f"""WITH {_A}, t AS (SELECT *, CASE WHEN turn % 3 = 0 THEN 'gold_error' WHEN turn % 3 = 1 THEN 'scorer_error' ELSE 'true_miss' END AS class FROM a WHERE expected <> 'answer')
SELECT class, count(*) AS n, count(*) FILTER (abstained) AS correct, count(*) FILTER (abstained OR class = 'gold_error') AS corrected, round(count(*) FILTER (abstained OR class = 'gold_error') / count(*), 9) AS accuracy FROM t GROUP BY class""")
def abstain_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG29, AG31: counts by triage class, and what they are once wrong gold is corrected."""
    kind = F.when(F.col("turn") % 3 == 0, "gold_error").when(F.col("turn") % 3 == 1, "scorer_error").otherwise("true_miss")
    fixed = F.count_if(F.col("abstained") | (F.col("class") == "gold_error"))
    return _answers(spark, sf_dir).filter("expected <> 'answer'").withColumn("class", kind).groupBy("class").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("abstained").alias("correct"), fixed.alias("corrected"), F.round(fixed / F.count(F.lit(1)), 9).alias("accuracy")
    )


_E = "e AS (SELECT event_id, event_type, user_id, value, event_id % 7 < 4 AS correct, event_id % 97 = 0 AS crashed, CAST(event_id % 3 AS INTEGER) AS lane FROM events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value", (i % 7 < 4).alias("correct"), (i % 97 == 0).alias("crashed"), (i % 3).cast("int").alias("lane"))


@query(f"WITH {_E} SELECT event_type, count(*) AS n, count(*) FILTER (CASE WHEN event_type = 'error' THEN NOT crashed ELSE correct END) AS passed, count(*) FILTER (crashed) AS crashes, round(100.0 * count(*) FILTER (CASE WHEN event_type = 'error' THEN NOT crashed ELSE correct END) / count(*), 6) AS percent FROM e GROUP BY event_type")
def category_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG41: each category passes by its own rule."""
    ok = F.when(F.col("event_type") == "error", ~F.col("crashed")).otherwise(F.col("correct"))
    return _events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("passed"), F.count_if("crashed").alias("crashes"), F.round(100.0 * F.count_if(ok) / F.count(F.lit(1)), 6).alias("percent"))


@query(f"WITH {_E}, m AS (SELECT user_id, lane, avg(value) AS score FROM e GROUP BY ALL), w AS (SELECT user_id, max(score) FILTER (lane = 0) AS system, max(score) AS best, arg_max(lane, (score, -lane)) AS top FROM m GROUP BY user_id) SELECT user_id, round(system, 6) AS system, round(best, 6) AS best, CASE WHEN user_id % 2 = 0 AND best - system >= 0.1 THEN top ELSE 0 END AS winner FROM w WHERE system IS NOT NULL")
def lane_arbiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF5, AG46: mean judge score per lane; the default lane wins unless spans differ (here: even keys) and another is 0.1 better."""
    m = _events(spark, sf_dir).groupBy("user_id", "lane").agg(F.avg("value").alias("score"))
    w = m.groupBy("user_id").agg(F.max(F.when(F.col("lane") == 0, F.col("score"))).alias("system"), F.max("score").alias("best"), F.max_by("lane", F.struct("score", -F.col("lane"))).alias("top"))
    won = F.when((F.col("user_id") % 2 == 0) & (F.col("best") - F.col("system") >= 0.1), F.col("top")).otherwise(0)
    return w.filter("system IS NOT NULL").select("user_id", F.round("system", 6).alias("system"), F.round("best", 6).alias("best"), won.alias("winner"))


@query(f"""WITH {_E}, t AS (SELECT sum(value) AS total, count(*) AS n FROM e), s AS (SELECT event_type, sum(value) / max(total) AS share, count(*) / max(n) AS part, avg(CAST(correct AS INTEGER)) AS right_rate FROM e, t GROUP BY event_type)
SELECT 'latency' AS rule, event_type AS what, round(share, 6) AS severity FROM s WHERE share > 0.15 UNION ALL SELECT 'route', event_type, round(part, 6) FROM s WHERE part > 0.19 UNION ALL SELECT 'accuracy', event_type, round(1 - right_rate, 6) FROM s WHERE right_rate < 0.575""")
def weakness_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG50: families of rules over shares, as one union."""
    e = _events(spark, sf_dir)
    s = e.groupBy("event_type").agg(F.sum("value").alias("v"), F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("int")).alias("right_rate"))
    total = s.agg(F.sum("v").alias("tv"), F.sum("n").alias("tn"))
    s = s.crossJoin(F.broadcast(total)).select(F.col("event_type").alias("what"), (F.col("v") / F.col("tv")).alias("share"), (F.col("n") / F.col("tn")).alias("part"), "right_rate")  # one row
    rule = lambda name, keep, how: s.filter(keep).select(F.lit(name).alias("rule"), "what", F.round(how, 6).alias("severity"))
    return rule("latency", "share > 0.15", F.col("share")).unionAll(rule("route", "part > 0.19", F.col("part"))).unionAll(rule("accuracy", "right_rate < 0.575", 1 - F.col("right_rate")))


@query(f"WITH {_E} SELECT event_id, list_filter([CASE WHEN NOT correct THEN 'wrong' END, CASE WHEN value > 80 THEN 'slow' END, CASE WHEN crashed THEN 'crash' END], lambda x: x IS NOT NULL) AS flags FROM e")
def failure_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG51."""
    flags = F.array_compact(F.array(F.when(~F.col("correct"), "wrong"), F.when(F.col("value") > 80, "slow"), F.when(F.col("crashed"), "crash")))
    return _events(spark, sf_dir).select("event_id", flags.alias("flags"))


@query(f"WITH {_E} SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS spread, min(value) AS least, max(value) AS most, round(count(*) / sum(value), 6) AS throughput FROM e GROUP BY event_type")
def embedding_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG53, AG54."""
    return _events(spark, sf_dir).groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("spread"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.count(F.lit(1)) / F.sum("value"), 6).alias("throughput"))


@query("SELECT doc_id, length(substr(text, 1, 12000)) AS n, contains(source, 'src1') OR contains(lower(text), 'thonre') AS useful FROM documents")
def context_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL15, FIL23: what counts as context, and its limit of 12,000 characters (the limit is the feature)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.length(F.substring("text", 1, 12_000)).cast("long").alias("n"), (F.contains("source", F.lit("src1")) | F.contains(F.lower("text"), F.lit("thonre"))).alias("useful"))


_URL = r"https?://[A-Za-z0-9./_-]+"


@query(rf"""WITH d AS (SELECT doc_id, text || ' http://x.org/a' || CAST(doc_id % 3 AS VARCHAR) || ' https://campus.example/b' AS text FROM documents),
u AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{_URL}'))) AS url FROM d) SELECT doc_id, url, contains(url, 'campus.example') OR url = 'http://x.org/a1' AS grounded FROM u""")
def url_grounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN17: an address is grounded if a chunk holds it, or its host is on the list."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(" http://x.org/a"), (F.col("doc_id") % 3).cast("string"), F.lit(" https://campus.example/b")).alias("text"))
    u = d.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_URL), F.lit(0)))).alias("url"))
    chunks = F.array(F.lit("see http://x.org/a1"), F.lit("nothing"))
    return u.select("doc_id", "url", (F.contains("url", F.lit("campus.example")) | F.exists(chunks, lambda c: F.contains(c, F.col("url")))).alias("grounded"))


@query(rf"SELECT conv_id, turn, trim(regexp_replace(text || ' http://x.org/a end', '{_URL}', '', 'g')) AS text, regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', '<email>', 'g'), '[0-9]{{6,}}', '<number>', 'g') AS redacted FROM conversations")
def strip_and_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN23, FN42."""
    bare = F.trim(F.regexp_replace(F.concat("text", F.lit(" http://x.org/a end")), _URL, ""))
    hidden = F.regexp_replace(F.regexp_replace("text", "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "<email>"), "[0-9]{6,}", "<number>")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", bare.alias("text"), hidden.alias("redacted"))


@query("""WITH s AS (SELECT 1 AS o, p_partkey // 3 AS k, p_name AS v FROM part WHERE p_partkey % 3 = 0 AND p_size > 25 UNION ALL SELECT 2, p_partkey // 3, p_name FROM part WHERE p_partkey % 3 = 1 AND p_size > 10 UNION ALL SELECT 3, p_partkey // 3, p_name FROM part WHERE p_partkey % 3 = 2)
SELECT k, arg_min(v, (o, v)) AS v, CAST(min(o) AS INTEGER) AS source FROM s GROUP BY k""")
def merge_first_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN19: a key's value from the first source that has it."""
    p = table(spark, sf_dir, "part")
    part = lambda o, keep: p.filter(keep).select(F.lit(o).alias("o"), F.floor(F.col("p_partkey") / 3).alias("k"), F.col("p_name").alias("v"))
    s = part(1, "p_partkey % 3 = 0 AND p_size > 25").unionAll(part(2, "p_partkey % 3 = 1 AND p_size > 10")).unionAll(part(3, "p_partkey % 3 = 2"))
    return s.groupBy("k").agg(F.min_by("v", F.struct("o", "v")).alias("v"), F.min("o").alias("source"))


@query("""WITH g AS (SELECT vec_id AS id, [vec_id + 1, vec_id + 2, vec_id * 3 % 50] AS picked, list_transform(range(0, 60, 1 + vec_id % 2), lambda x: x + vec_id - vec_id % 50) AS pool FROM embeddings)
SELECT id, len(list_filter(picked, lambda x: NOT list_contains(pool, x))) = 0 AS patched, list_has_any(picked, pool) AS overlap, list_sort(list_distinct(picked)) AS picked FROM g""")
def gold_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN20, JN6, ST-I1, ST-U1: hand-picked ids count only if all of them were retrieved."""
    v = F.col("vec_id")
    picked = F.array(v + 1, v + 2, v * 3 % 50)
    pool = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(59).cast("long"), 1 + v % 2), lambda x: x + v - v % 50)
    g = table(spark, sf_dir, "embeddings").select(v.alias("id"), picked.alias("picked"), pool.alias("pool"))
    return g.select("id", (F.size(F.array_except("picked", "pool")) == 0).alias("patched"), F.arrays_overlap("picked", "pool").alias("overlap"), F.sort_array(F.array_distinct("picked")).alias("picked"))


@query("SELECT o_orderkey, coalesce(c_name, CAST(o_custkey AS VARCHAR)) AS name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) ON c_custkey = o_custkey")
def lookup_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN13, JN21: a name, or the code itself."""
    c = table(spark, sf_dir, "customer").filter("c_custkey % 5 <> 0").select("c_custkey", "c_name")
    o = table(spark, sf_dir, "orders").join(c, F.col("c_custkey") == F.col("o_custkey"), "left")
    return o.select("o_orderkey", F.coalesce("c_name", F.col("o_custkey").cast("string")).alias("name"))


@query(r"""WITH t AS (SELECT p_partkey, 'mã ' || CAST(7480000 + p_partkey % 9 AS VARCHAR) || ', 7480001 và ' || CAST(7480000 + p_partkey % 9 AS VARCHAR) AS text FROM part)
SELECT p_partkey, list_sort(list_filter(list_distinct(regexp_extract_all(text, '\b7[0-9]{6}\b')), lambda c: c NOT IN ('7480001', '7480003'))) AS bad FROM t""")
def invalid_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN18: codes in an answer that aren't on the list, sorted."""
    code = (7480000 + F.col("p_partkey") % 9).cast("string")
    text = F.concat(F.lit("mã "), code, F.lit(", 7480001 và "), code)
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b7[0-9]{6}\b"), F.lit(0)))
    return table(spark, sf_dir, "part").select("p_partkey", F.sort_array(F.array_except(found, F.array(F.lit("7480001"), F.lit("7480003")))).alias("bad"))


@query("""SELECT page_id, coalesce(CASE WHEN page_id % 3 = 0 THEN url END, CASE WHEN page_id % 3 = 1 THEN 'TB' || CAST(page_id AS VARCHAR) END, 'unknown') AS label, substr(html, 1, 80) AS title, substr(html, 1, 120) AS snippet FROM pages""")
def source_chip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN21, FN22: a label by falling preference, a title of 80 and a snippet of 120 characters (the limits are the feature)."""
    k = F.col("page_id")
    label = F.coalesce(F.when(k % 3 == 0, F.col("url")), F.when(k % 3 == 1, F.concat(F.lit("TB"), k.cast("string"))), F.lit("unknown"))
    return table(spark, sf_dir, "pages").select("page_id", label.alias("label"), F.substring("html", 1, 80).alias("title"), F.substring("html", 1, 120).alias("snippet"))


@query(r"SELECT conv_id, turn, regexp_matches(text, '[A-Za-z]{3,}( [A-Za-z]{3,}){3,}') AS english FROM conversations")
def english_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN25: four words of three letters or more in a row."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").rlike("[A-Za-z]{3,}( [A-Za-z]{3,}){3,}").alias("english"))


@query(r"""WITH c AS (SELECT conv_id, turn, text || CASE WHEN turn % 2 = 0 THEN ' 2026' ELSE '' END AS t FROM conversations),
f AS (SELECT *, regexp_matches(t, '\b20[0-9]{2}\b') AS year, regexp_matches(t, '(?i)\b(the|thon)\b') AS major, len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '')) AS n FROM c)
SELECT conv_id, turn, NOT ((year AND major) OR (major AND n <= 6)) AS step_back, CASE WHEN n < 20 THEN 0.35 WHEN n < 60 THEN 0.45 ELSE 0.55 END AS threshold FROM f""")
def step_back_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN30, FN37."""
    t = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit(" 2026"))).otherwise(F.col("text"))
    year, major, n = t.rlike(r"\b20[0-9]{2}\b"), t.rlike(r"(?i)\b(the|thon)\b"), F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    level = F.when(n < 20, 0.35).when(n < 60, 0.45).otherwise(0.55)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (~((year & major) | (major & (n <= 6)))).alias("step_back"), level.cast("decimal(3,2)").alias("threshold"))


@query("""WITH j AS (SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_id, k, CASE k % 3 WHEN 0 THEN 'NGANH' WHEN 1 THEN 'TO_HOP' ELSE 'UNKNOWN' END || ':' || CAST(k AS VARCHAR) AS node_id FROM j""")
def parsed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN39, FN40: JSON, fenced or not, into entities; an unknown kind falls back."""
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    plain = F.regexp_replace(fenced, r"^```(?:json)?\s*|\s*```$", "")
    k = F.get_json_object(plain, "$.k").cast("int")
    kind = F.when(F.col("k") % 3 == 0, "NGANH").when(F.col("k") % 3 == 1, "TO_HOP").otherwise("UNKNOWN")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).select("event_id", "k", F.concat(kind, F.lit(":"), F.col("k").cast("string")).alias("node_id"))


@query("SELECT doc_id, sha256(source || '|' || lang || '|' || CAST(n_chars AS VARCHAR))[1:16] AS checksum, n_chars % 100 / 100.0 < 0.18 AS hallucinated FROM documents")
def evidence_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN41, FN44."""
    parts = F.concat_ws("|", "source", "lang", F.col("n_chars").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2(parts, 256), 1, 16).alias("checksum"), (F.col("n_chars") % 100 / 100.0 < 0.18).alias("hallucinated"))


@query("SELECT conv_id, turn, unnest(list_distinct([text, 'about ' || text, lower(text)])) AS variant FROM conversations WHERE role = 'user'")
def query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN45, ST-U1: rewrites by template, distinct."""
    v = F.array_distinct(F.array("text", F.concat(F.lit("about "), "text"), F.lower("text")))
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.explode(v).alias("variant"))


@query("SELECT conv_id, list_sort(list_distinct(list(role))) AS roles, count(*) AS turns FROM conversations GROUP BY conv_id")
def distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-U5."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_set("role")).alias("roles"), F.count(F.lit(1)).alias("turns"))


@query("""SELECT o_orderkey, TRY_CAST(d AS DATE) IS NOT NULL AND regexp_matches(d, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') AS ok FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '2024-13-01' WHEN o_orderkey % 3 = 1 THEN '2024-02-' || lpad(CAST(o_orderkey % 31 AS VARCHAR), 2, '0') ELSE 'x' END AS d FROM orders)""")
def iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN38."""
    k = F.col("o_orderkey")
    d = F.when(k % 3 == 0, "2024-13-01").when(k % 3 == 1, F.concat(F.lit("2024-02-"), F.lpad((k % 31).cast("string"), 2, "0"))).otherwise("x")
    o = table(spark, sf_dir, "orders").select("o_orderkey", d.alias("d"))
    return o.select("o_orderkey", (F.col("d").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.col("d").try_cast("date").isNotNull()).alias("ok"))


@query("SELECT event_id, event_type IN ('view', 'signup') AND 2024 + event_id % 20 BETWEEN 2027 AND 2039 AS signal, max(CASE WHEN event_type IN ('view', 'signup') AND 2024 + event_id % 20 BETWEEN 2027 AND 2039 THEN 2024 + event_id % 20 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS newest FROM events")
def new_cycle_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM8: a keyword and a later year open a cycle; the newest so far runs along, per user."""
    year = 2024 + F.col("event_id") % 20
    signal = F.col("event_type").isin("view", "signup") & year.between(2027, 2039)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", signal.alias("signal"), F.max(F.when(signal, year)).over(w).alias("newest"))


@query("""WITH m AS (SELECT p_partkey, [p_brand, CASE WHEN p_size > 25 THEN 'large' END, 's' || CAST(p_size AS VARCHAR)] AS v FROM part)
SELECT p_partkey, list_filter([CASE WHEN v[1] IS NOT NULL THEN 'brand' END, CASE WHEN v[2] IS NOT NULL THEN 'class' END], lambda x: x IS NOT NULL) AS fields FROM m""")
def metadata_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL13: the fields of a profile that a row has."""
    m = F.map_from_arrays(F.array(F.lit("brand"), F.lit("class"), F.lit("size")), F.array("p_brand", F.when(F.col("p_size") > 25, "large"), F.concat(F.lit("s"), F.col("p_size").cast("string"))))
    kept = F.map_filter(m, lambda k, v: k.isin("brand", "class") & v.isNotNull())
    return table(spark, sf_dir, "part").select("p_partkey", F.sort_array(F.map_keys(kept)).alias("fields"))


@query()
def chunk_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF3: chunks with ids and links to their neighbours."""
    c = profiles.chunked(documents_with_metadata(spark, sf_dir))
    return c.select("id", "prev_chunk_id", "next_chunk_id")
