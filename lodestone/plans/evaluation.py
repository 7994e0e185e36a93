"""Queries of evaluation: ranking metrics, percentiles, gates, pivots and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import metrics, resample
from lodestone.plans.registry import query, table
from lodestone.plans.retrieval import _DENSE, dense

KS = (1, 3, 5)
_IR = f"""WITH {_DENSE}, ret AS (SELECT qid, vec_id AS item, rank FROM dr WHERE rank <= 10),
gold AS (SELECT a.vec_id AS qid, b.vec_id AS item FROM v a JOIN v b ON a.label = b.label WHERE a.vec_id % 50 = 0),
tot AS (SELECT qid, count(*) AS n_relevant FROM gold GROUP BY qid),
hit AS (SELECT qid, rank FROM ret JOIN gold USING (qid, item)),
g AS (SELECT tot.qid, n_relevant, {', '.join(f"count(rank) FILTER (rank <= {k}) AS n{k}, coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= {k}), 0) AS d{k}, (SELECT sum(1 / log2(i + 1)) FROM range(1, 1 + least(n_relevant, {k})) AS t(i)) AS i{k}" for k in KS)}, min(rank) AS f
  FROM tot LEFT JOIN hit USING (qid) GROUP BY tot.qid, n_relevant)
"""


def _ir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a query's own label are relevant: they are counted by label, and only those found are looked at one by one."""
    e = table(spark, sf_dir, "embeddings").filter("label is not null").select("vec_id", "label")
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("label").alias("own"))
    sizes = e.groupBy(F.col("label").alias("own")).agg(F.count(F.lit(1)).alias("n_relevant"))
    found = dense(spark, sf_dir, 10).select("qid", "vec_id", "rank").join(e, "vec_id").join(asked, "qid")
    return metrics.per_marked(found.select("qid", "rank", (F.col("label") == F.col("own")).alias("hit")), asked.join(sizes, "own").select("qid", "n_relevant"), KS)


def _means(prefix: str) -> list:
    return [F.round(F.avg(f"{prefix}_at_{k}"), 9).alias(f"{prefix}_at_{k}") for k in KS]


@query(_IR + "SELECT " + ", ".join(f"round(avg(n{k} / {k}), 9) AS p_at_{k}" for k in KS) + " FROM g")
def ir_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG21."""
    return _ir(spark, sf_dir).agg(*_means("p"))


@query(_IR + "SELECT " + ", ".join(f"round(avg(n{k} / n_relevant), 9) AS r_at_{k}" for k in KS) + " FROM g")
def ir_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG22."""
    return _ir(spark, sf_dir).agg(*_means("r"))


@query(_IR + "SELECT round(avg(coalesce(1 / f, 0)), 9) AS mrr FROM g")
def ir_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG23."""
    return _ir(spark, sf_dir).agg(F.round(F.avg("rr"), 9).alias("mrr"))


@query(_IR + "SELECT " + ", ".join(f"round(avg(CAST(n{k} > 0 AS INTEGER)), 9) AS hit_at_{k}" for k in KS) + " FROM g")
def ir_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG24."""
    return _ir(spark, sf_dir).agg(*_means("hit"))


@query(_IR + "SELECT " + ", ".join(f"round(avg(d{k} / i{k}), 9) AS ndcg_at_{k}" for k in KS) + " FROM g")
def ir_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG26, binary."""
    return _ir(spark, sf_dir).agg(*_means("ndcg"))


@query(f"""WITH {_DENSE}, r AS (SELECT qid, rank, CAST(vec_id % 4 AS INTEGER) AS rel FROM dr WHERE rank <= 10),
b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, rank) AS best FROM r),
s AS (SELECT qid, sum((2 ** rel - 1) / log2(rank + 1)) FILTER (rank <= 5) AS d, sum((2 ** rel - 1) / log2(best + 1)) FILTER (best <= 5) AS i FROM b GROUP BY qid)
SELECT qid, round(CASE WHEN i > 0 THEN d / i ELSE 0 END, 9) AS ndcg FROM s""")
def ir_ndcg_graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG26, graded."""
    r = dense(spark, sf_dir, 10).select("qid", "rank", (F.col("vec_id") % 4).cast("int").alias("rel"))
    return metrics.graded_ndcg(r, 5).select("qid", F.round("ndcg", 9).alias("ndcg"))


@query(_IR + "SELECT round(avg(n_relevant) / 5, 9) AS ceiling FROM g")
def precision_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG25."""
    return _ir(spark, sf_dir).agg(F.round(F.avg("n_relevant") / 5, 9).alias("ceiling"))


@query(f"""WITH {_DENSE}, rec AS (SELECT qid, list(vec_id) AS chunks FROM dr WHERE rank <= 10 GROUP BY qid),
facts AS (SELECT a.vec_id AS qid, u.i AS fact, [a.vec_id + u.i, (a.vec_id * 7 + u.i * 13) % 500, a.label * 10 + u.i] AS support FROM v a, range(0, 12) AS u(i) WHERE a.vec_id % 50 = 0)
SELECT qid, CAST(sum(CAST(list_has_any(support, chunks) AS INTEGER)) AS BIGINT) AS hits, count(*) AS facts, round(sum(CAST(list_has_any(support, chunks) AS INTEGER)) / count(*), 9) AS recall FROM facts JOIN rec USING (qid) GROUP BY qid""")
def context_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG27, JN5, JN6."""
    rec = dense(spark, sf_dir, 10).groupBy("qid").agg(F.collect_list("vec_id").alias("chunks"))
    e = table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0")
    q, i = F.col("vec_id"), F.col("i")
    facts = e.select("vec_id", "label", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("i")).select(
        q.alias("qid"), i.alias("fact"), F.array(q + i, (q * 7 + i * 13) % 500, (F.col("label") * 10 + i).cast("long")).alias("support")
    )
    return metrics.context_recall(rec, facts).withColumn("recall", F.round("recall", 9))


@query("""WITH s AS (SELECT event_type, value FROM events)
SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS most, round(avg(value), 6) AS mean, count(value) AS n FROM s GROUP BY event_type""")
def latency_seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG10, AG11, AG14, AG32: exact interpolated percentiles per seam; nulls don't count."""
    r = lambda c: F.round(c, 6)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        r(metrics.percentile("value", 0.5)).alias("p50"), r(metrics.percentile("value", 0.95)).alias("p95"), r(F.max("value")).alias("most"), r(F.avg("value")).alias("mean"), F.count("value").alias("n")
    )


@query("""WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY event_type)
SELECT event_type, v[(len(v) - 1) // 2 + 1] AS median, v[CAST(floor((len(v) - 1) * 0.95) AS BIGINT) + 1] AS p95, v[CAST(floor(len(v) * 0.5) AS BIGINT) + 1] AS p50_index FROM s""")
def latency_order_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG12, AG13: order statistics without interpolation."""
    places = {"median": lambda n: F.floor((n - 1) / 2), "p95": lambda n: F.floor((n - 1) * 0.95), "p50_index": lambda n: F.floor(n * 0.5)}
    return metrics.order_stats(table(spark, sf_dir, "events"), "event_type", "value", places)


@query("SELECT min(n_chars) AS least, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.95), 6) AS p95, max(n_chars) AS most, round(avg(n_chars), 6) AS mean FROM documents")
def answer_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG33, AG45."""
    return table(spark, sf_dir, "documents").agg(
        F.min("n_chars").alias("least"), F.round(F.percentile("n_chars", 0.5), 6).alias("p50"), F.round(F.percentile("n_chars", 0.95), 6).alias("p95"), F.max("n_chars").alias("most"), F.round(F.avg("n_chars"), 6).alias("mean")
    )


_REC = """rec AS (SELECT e.event_id, e.event_type AS route, CASE e.user_id % 3 WHEN 0 THEN 'simple' WHEN 1 THEN 'multihop' ELSE 'comparative' END AS category, e.user_id AS question, e.value AS latency,
  e.event_id % 7 < 4 AS correct, e.event_id % 11 < 2 AS hallucinated, e.event_id % 5 < 3 AS recalled, e.event_id % 13 / 13.0 AS grounded FROM events e)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    kind = F.when(F.col("user_id") % 3 == 0, "simple").when(F.col("user_id") % 3 == 1, "multihop").otherwise("comparative")
    return e.select(
        "event_id", F.col("event_type").alias("route"), kind.alias("category"), F.col("user_id").alias("question"), F.col("value").alias("latency"),
        (i % 7 < 4).alias("correct"), (i % 11 < 2).alias("hallucinated"), (i % 5 < 3).alias("recalled"), (i % 13 / 13.0).alias("grounded"),
    )


@query(f"""WITH {_REC} SELECT route, count(*) AS n, round(avg(CAST(correct AS INTEGER)), 4) AS accuracy, round(avg(CAST(recalled AS INTEGER)), 4) AS recall, round(avg(CAST(hallucinated AS INTEGER)), 4) AS hallucination,
round(avg(grounded), 4) AS groundedness, round(quantile_cont(latency, 0.5), 4) AS p50, round(quantile_cont(latency, 0.95), 4) AS p95 FROM rec GROUP BY route""")
def route_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG9, AG15."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 4)
    return _records(spark, sf_dir).groupBy("route").agg(
        F.count(F.lit(1)).alias("n"), rate("correct").alias("accuracy"), rate("recalled").alias("recall"), rate("hallucinated").alias("hallucination"),
        F.round(F.avg("grounded"), 4).alias("groundedness"), F.round(F.percentile("latency", 0.5), 4).alias("p50"), F.round(F.percentile("latency", 0.95), 4).alias("p95"),
    )


@query(f"WITH {_REC} SELECT category, route, recalled, count(*) AS n, round(avg(CAST(correct AS INTEGER)), 6) AS accuracy, CAST(grouping_id(category, route, recalled) AS BIGINT) AS level FROM rec GROUP BY CUBE (category, route, recalled)")
def category_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG15, AG16, AG20: all levels of the cross table as one cube."""
    return _records(spark, sf_dir).cube("category", "route", "recalled").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"), F.grouping_id("category", "route", "recalled").cast("long").alias("level")
    )


_ROUTES = ("click", "error", "purchase", "signup", "view")


@query(f"WITH {_REC} SELECT category, {', '.join(f'''round(avg(CAST(correct AS INTEGER)) FILTER (route = '{r}'), 6) AS "{r}"''' for r in _ROUTES)} FROM rec GROUP BY category")
def category_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG17: category by route; the routes are given, so no pass is spent on finding them."""
    return _records(spark, sf_dir).groupBy("category").pivot("route", list(_ROUTES)).agg(F.round(F.avg(F.col("correct").cast("int")), 6))


_KINDS = ("correct", "hallucination", "retrieval_miss", "reasoning_error")


@query(f"""WITH {_REC}, t AS (SELECT route, CASE WHEN correct THEN 'correct' WHEN hallucinated THEN 'hallucination' WHEN NOT recalled THEN 'retrieval_miss' ELSE 'reasoning_error' END AS kind FROM rec)
SELECT route, {', '.join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in _KINDS)} FROM t GROUP BY route""")
def error_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG18."""
    kind = metrics.error_type(F.col("correct"), F.col("hallucinated"), F.col("recalled"))
    return _records(spark, sf_dir).withColumn("kind", kind).groupBy("route").pivot("kind", list(_KINDS)).count().na.fill(0)


@query(f"""WITH {_REC}, f AS (SELECT question, count(*) AS failures, array_to_string(list_sort(list_distinct(list(route))), ',') AS routes, round(avg(grounded), 6) AS grounded FROM rec WHERE NOT correct GROUP BY question)
SELECT * FROM f ORDER BY failures DESC, question LIMIT 10""")
def worst_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG19: a top-ten report."""
    f = _records(spark, sf_dir).filter("NOT correct").groupBy("question").agg(
        F.count(F.lit(1)).alias("failures"), F.array_join(F.sort_array(F.collect_set("route")), ",").alias("routes"), F.round(F.avg("grounded"), 6).alias("grounded")
    )
    return f.orderBy(F.desc("failures"), "question").limit(10)


_W = "(s / n + 3.8416 / (2 * n) - 1.96 * sqrt(s / n * (1 - s / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)"


@query(f"""WITH {_REC}, c AS (SELECT question % 40 AS g, CAST(count(*) FILTER (grounded < 0.9) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS n FROM rec GROUP BY g)
SELECT g, CAST(n AS BIGINT) AS n, round(greatest(0, {_W}), 9) AS low, CASE WHEN n < 30 THEN 'informational' WHEN {_W} >= 0.85 THEN 'pass' ELSE 'fail' END AS verdict FROM c""")
def wilson_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG28."""
    r = _records(spark, sf_dir)
    c = r.groupBy((F.col("question") % 40).alias("g")).agg(F.count_if(F.col("grounded") < 0.9).alias("s"), F.count(F.lit(1)).alias("n"))
    s, n = F.col("s").cast("double"), F.col("n").cast("double")
    return c.select("g", "n", F.round(metrics.wilson_low(s, n), 9).alias("low"), metrics.verdict(s, n).alias("verdict"))


@query(f"""WITH {_REC}, m AS (SELECT 'faithfulness' AS metric, avg(grounded) AS value FROM rec UNION ALL SELECT 'context_recall', avg(CAST(recalled AS INTEGER)) FROM rec UNION ALL SELECT 'accuracy', avg(CAST(correct AS INTEGER)) FROM rec),
g(metric, floor) AS (VALUES ('faithfulness', 0.9), ('context_recall', 0.55), ('abstain', 0.95))
SELECT g.metric, CAST(floor AS DOUBLE) AS floor, round(value, 9) AS value, CASE WHEN value >= floor THEN 'PASS' ELSE 'FAIL' END AS status FROM g LEFT JOIN m USING (metric)""")
def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG34: means against thresholds; a missing mean fails."""
    r = _records(spark, sf_dir).agg(F.avg("grounded").alias("faithfulness"), F.avg(F.col("recalled").cast("int")).alias("context_recall"), F.avg(F.col("correct").cast("int")).alias("accuracy"))
    m = r.unpivot([], ["faithfulness", "context_recall", "accuracy"], "metric", "value")
    gates = spark.createDataFrame([("faithfulness", 0.9), ("context_recall", 0.55), ("abstain", 0.95)], "metric string, floor double")
    return gates.join(m, "metric", "left").select("metric", "floor", F.round("value", 9).alias("value"), F.when(F.col("value") >= F.col("floor"), "PASS").otherwise("FAIL").alias("status"))


@query(f"WITH {_REC}, r AS (SELECT category, question % 5 AS run, avg(grounded) AS score FROM rec GROUP BY ALL) SELECT category, count(*) AS runs, round(stddev_samp(score), 9) AS spread, count(*) >= 3 AND stddev_samp(score) <= 0.02 AS stable FROM r GROUP BY category")
def rerun_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG36."""
    r = _records(spark, sf_dir).groupBy("category", (F.col("question") % 5).alias("run")).agg(F.avg("grounded").alias("score"))
    s = r.groupBy("category").agg(F.count(F.lit(1)).alias("runs"), F.stddev_samp("score").alias("spread"))
    return s.select("category", "runs", F.round("spread", 9).alias("spread"), ((F.col("runs") >= 3) & (F.col("spread") <= 0.02)).alias("stable"))


@query(f"""WITH {_REC}, a AS (SELECT category, avg(CAST(correct AS INTEGER)) FILTER (question % 2 = 0) AS cand, avg(CAST(correct AS INTEGER)) FILTER (question % 2 = 1) AS ctrl, avg(latency) FILTER (question % 2 = 0) AS lc, avg(latency) FILTER (question % 2 = 1) AS lt FROM rec GROUP BY category)
SELECT category, round(cand - ctrl, 9) AS delta, cand - ctrl >= -0.02 AS accuracy_ok, lc - lt <= 0.5 AS latency_ok FROM a""")
def non_inferiority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG37."""
    side = lambda v, k: F.avg(F.when(F.col("question") % 2 == k, v))
    right, wait = F.col("correct").cast("int"), F.col("latency")
    a = _records(spark, sf_dir).groupBy("category").agg(side(right, 0).alias("cand"), side(right, 1).alias("ctrl"), side(wait, 0).alias("lc"), side(wait, 1).alias("lt"))
    return a.select("category", F.round(F.col("cand") - F.col("ctrl"), 9).alias("delta"), metrics.non_inferior(F.col("cand"), F.col("ctrl"), 0.02).alias("accuracy_ok"), metrics.non_inferior(F.col("lc"), F.col("lt"), 0.5, False).alias("latency_ok"))


@query("""WITH a AS (SELECT event_id AS idx, event_type AS route FROM events), b AS (SELECT event_id AS idx, CASE WHEN event_id % 17 = 0 THEN 'other' ELSE event_type END AS route FROM events)
SELECT count(*) AS n, count(*) FILTER (a.route <> b.route) AS mismatches, round(100.0 * count(*) FILTER (a.route <> b.route) / count(*), 6) AS percent FROM a FULL JOIN b USING (idx)""")
def route_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN15: two runs compared by position."""
    a = table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), F.col("event_type").alias("ra"))
    b = table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), F.when(F.col("event_id") % 17 == 0, "other").otherwise(F.col("event_type")).alias("rb"))
    wrong = F.count_if(F.col("ra") != F.col("rb"))
    return a.join(b, "idx", "full").agg(F.count(F.lit(1)).alias("n"), wrong.alias("mismatches"), F.round(100.0 * wrong / F.count(F.lit(1)), 6).alias("percent"))


@query("""WITH need AS (SELECT t AS event_type, CAST(u AS BIGINT) AS user_id FROM (SELECT DISTINCT event_type AS t FROM events), range(0, 400) AS r(u))
SELECT event_type, user_id FROM need ANTI JOIN events USING (event_type, user_id)""")
def matrix_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG55, ST-E1: required combinations that don't occur."""
    e = table(spark, sf_dir, "events")
    need = e.select("event_type").distinct().select("event_type", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(399).cast("long"))).alias("user_id"))
    return need.join(e.select("event_type", "user_id").distinct(), ["event_type", "user_id"], "left_anti")


@query("""SELECT 'lang' AS field, coalesce(lang, 'null') AS value, count(*) AS n FROM documents GROUP BY 2
UNION ALL SELECT 'year', coalesce(CAST(CASE WHEN doc_id % 9 = 0 THEN NULL ELSE 2020 + doc_id % 7 END AS VARCHAR), 'null'), count(*) FROM documents GROUP BY 2""")
def year_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG8: distributions with a bucket for nulls."""
    d = table(spark, sf_dir, "documents").select("lang", F.when(F.col("doc_id") % 9 != 0, 2020 + F.col("doc_id") % 7).alias("year"))
    return metrics.distribution(d, ["lang", "year"])


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, CAST(max(year(o_orderdate)) OVER () AS INTEGER) AS latest FROM orders GROUP BY year(o_orderdate)")
def distinct_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG43."""
    y = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    return y.crossJoin(y.agg(F.max("year").alias("latest")))  # one row


@query("SELECT greatest(0, date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '1999-01-01')) AS lag_days, date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '1999-01-01') > 90 AS stale FROM orders")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG44, with a given `now`."""
    lag = F.datediff(F.lit("1999-01-01").cast("date"), F.max("o_orderdate").cast("date"))
    return table(spark, sf_dir, "orders").agg(F.greatest(F.lit(0), lag).cast("long").alias("lag_days"), (lag > 90).alias("stale"))


@query(r"""WITH b AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS ws FROM benchmark),
d AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS ws FROM documents),
t AS (SELECT item_id, len(ws) AS n, unnest(ws) AS w FROM b), u AS (SELECT doc_id, unnest(ws) AS w FROM d),
g AS (SELECT item_id, doc_id, count(*) / n AS g FROM t JOIN u USING (w) GROUP BY item_id, doc_id, n)
SELECT item_id, max(g.doc_id) FILTER (g.g = m.g AND g.doc_id = m.d) AS doc_id, round(max(g.g), 9) AS grounded FROM g JOIN (SELECT item_id, max(g) AS g, arg_max(doc_id, (g, -doc_id)) AS d FROM g GROUP BY item_id) m USING (item_id) GROUP BY item_id""")
def groundedness_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG48: each answer against every source; the best one is returned (ties: the smaller doc_id)."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != ""))
    b = table(spark, sf_dir, "benchmark").select("item_id", words.alias("a"))
    d = table(spark, sf_dir, "documents").select("doc_id", words.alias("s"))
    best = metrics.best_grounded(b, d)
    return best.select("item_id", "doc_id", F.round("grounded", 9).alias("grounded"))


@query(r"""WITH t AS (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS term FROM documents)
SELECT term, count(*) AS n FROM t GROUP BY term ORDER BY n DESC, term LIMIT 20""")
def term_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG56: a top-twenty report."""
    t = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), r"\s+")).alias("term")).filter("term <> ''")
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(20)


_RESAMPLES, _SEED = 2000, 42


@query(f"""WITH d AS (SELECT r, CAST(quality AS DOUBLE) AS v, {resample.draws_sql("doc_id", "r", _SEED)} AS x FROM labels, range({_RESAMPLES}) AS t(r) WHERE quality IS NOT NULL),
w AS (SELECT r, v, {" + ".join(f"CAST(x > {int(c * (resample.MASK + 1))} AS INTEGER)" for c in resample.SHARES)} AS w FROM d),
m AS (SELECT r, sum(w * v) / sum(w) AS m FROM w GROUP BY r)
SELECT (SELECT count(quality) FROM labels) AS n, (SELECT round(avg(quality), 9) FROM labels) AS mean, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high, CAST({_RESAMPLES} AS BIGINT) AS resamples FROM m""")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG35: the share of good documents with its interval, from 2,000 Poisson resamples."""
    b = resample.bootstrap(table(spark, sf_dir, "labels"), "quality", "doc_id", _RESAMPLES, seed=_SEED)
    return b.withColumns({c: F.round(c, 9) for c in ("mean", "low", "high")})
