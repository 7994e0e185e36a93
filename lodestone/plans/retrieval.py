"""Queries of dense and sparse retrieval, fusion, re-ranking, cutoffs, injection and confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import bm25, filters, fusion, knn
from lodestone.plans.registry import query, table


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set of all searches: every row whose id is divisible by 50."""
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


def dense(spark: SparkSession, sf_dir: str, k: int, metric: str = "cosine") -> DataFrame:
    return knn.nearest(_queries(spark, sf_dir), table(spark, sf_dir, "embeddings"), k, metric)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set of text searches: the first user turn of each conversation whose number is divisible by 50."""
    c = table(spark, sf_dir, "conversations").filter((F.col("conv_id") % 50 == 0) & (F.col("role") == "user"))
    return c.groupBy(F.col("conv_id").alias("qid")).agg(F.min_by("text", "turn").alias("qtext"))


def sparse(spark: SparkSession, sf_dir: str, k: int, legacy: bool = False) -> DataFrame:
    cut = bm25.long_tokens if legacy else bm25.tokens
    asked = _texts(spark, sf_dir).select("qid", cut("qtext").alias("qwords"))
    return bm25.search(table(spark, sf_dir, "documents").select("doc_id", cut("text").alias("words")), asked, k)


_COS = "list_inner_product(a.v, b.v) / ((sqrt(list_inner_product(a.v, a.v)) + 1e-8) * (sqrt(list_inner_product(b.v, b.v)) + 1e-8))"
_DENSE = f"""
v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (
  SELECT a.vec_id AS qid, b.vec_id, {_COS} AS score, list_inner_product(a.v, a.v) + list_inner_product(b.v, b.v) - 2 * list_inner_product(a.v, b.v) AS dist
  FROM v a, v b WHERE a.vec_id % 50 = 0),
dr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM d)
"""
_TOKENS = r"list_filter(regexp_split_to_array(lower({}), '\s+'), lambda w: w <> '')"
_BM25 = rf"""
q AS (SELECT CAST(qid AS BIGINT) AS qid, unnest({_TOKENS.format("t")}) AS term FROM (SELECT conv_id AS qid, arg_min(text, turn) AS t FROM conversations WHERE conv_id % 50 = 0 AND role = 'user' GROUP BY conv_id)),
qt AS (SELECT qid, term, count(*) AS times FROM q GROUP BY ALL),
w AS (SELECT doc_id, {_TOKENS.format("text")} AS ws FROM documents),
st AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM w),
df AS (SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(ws)) AS term FROM w) GROUP BY term),
idf AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, st),
mi AS (SELECT avg(idf) AS mean_idf, count(*) AS terms FROM idf),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS dl, unnest(ws) AS term FROM w) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
bs AS (
  SELECT qid, doc_id, sum(times * CASE WHEN idf < 0 THEN 0.25 * mean_idf ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM tf JOIN idf USING (term) JOIN qt USING (term), mi, st GROUP BY ALL),
br AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bs WHERE score > 0)
"""


@query(f"WITH {_DENSE} SELECT qid, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM dr WHERE rank <= 10")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KNN1, TK1, SRC11: the ten nearest vectors."""
    return dense(spark, sf_dir, 10).select("qid", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_DENSE} SELECT qid, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM dr WHERE rank <= 5")
def dense_multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK9, SRC13: a batch of queries in one pass."""
    return dense(spark, sf_dir, 5).select("qid", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {_DENSE}, l AS (SELECT qid, vec_id, 1 / (1 + greatest(dist, 0)) AS score FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM l)
SELECT qid, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def dense_l2_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KNN2, FIL7: scores of 1 / (1 + squared distance)."""
    return dense(spark, sf_dir, 5, metric="l2").select("qid", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {_DENSE}, f AS (SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM d JOIN v USING (vec_id) WHERE label IN (1, 3))
SELECT qid, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM f WHERE rank <= 5""")
def dense_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC11, TK2: the filter runs in the scan, before the search, so nothing is over-fetched."""
    kept = table(spark, sf_dir, "embeddings").filter(F.col("label").isin(1, 3))
    return knn.nearest(_queries(spark, sf_dir), kept, 5).select("qid", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_BM25} SELECT qid, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM br WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM1, BM2, FIL19."""
    return sparse(spark, sf_dir, 10).select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_BM25} SELECT n, round(avgdl, 6) AS avgdl, round(mean_idf, 6) AS mean_idf, terms FROM st, mi")
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG49: the corpus statistics."""
    s = bm25.stats(table(spark, sf_dir, "documents").select(bm25.tokens("text").alias("words")))
    return s.select("n", F.round("avgdl", 6).alias("avgdl"), F.round("mean_idf", 6).alias("mean_idf"), "terms")


@query(rf"""WITH w AS (SELECT doc_id, list_filter({_TOKENS.format("text")}, lambda w: len(w) > 2 AND w NOT IN ('và', 'các', 'của', 'có', 'được', 'cho', 'trong', 'là', 'một', 'này', 'để', 'với', 'theo', 'từ', 'đã', 'sẽ', 'không', 'khi', 'bằng', 'the', 'a', 'an', 'is', 'are')) AS ws FROM documents)
SELECT doc_id, CAST(len(ws) AS INTEGER) AS n_tokens, CAST(len(list_distinct(ws)) AS INTEGER) AS n_terms FROM w""")
def bm25_legacy_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM3: the older tokenizer."""
    w = table(spark, sf_dir, "documents").select("doc_id", bm25.long_tokens("text").alias("ws"))
    return w.select("doc_id", F.size("ws").alias("n_tokens"), F.size(F.array_distinct("ws")).alias("n_terms"))


_HYBRID = f"""WITH {_DENSE}, {_BM25},
one AS (SELECT qid, vec_id AS doc_id, rank FROM dr WHERE rank <= 20),
two AS (SELECT qid, doc_id, rank FROM br WHERE rank <= 20 AND qid IN (SELECT qid FROM one)),
f AS (SELECT qid, doc_id, coalesce({{0}} / (60 + one.rank), 0) + coalesce({{1}} / (60 + two.rank), 0) AS score FROM one FULL JOIN two USING (qid, doc_id)),
fr AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, doc_id) AS rank FROM f)
"""


def _hybrid(spark: SparkSession, sf_dir: str, w_dense: float, w_sparse: float) -> DataFrame:
    one = dense(spark, sf_dir, 20).select("qid", F.col("vec_id").alias("doc_id"), "rank")
    # Each vector goes with the text of the conversation of its number, if there is one.
    two = sparse(spark, sf_dir, 20).join(_queries(spark, sf_dir).select("qid"), "qid", "left_semi").select("qid", "doc_id", "rank")
    fused = fusion.rrf([(one, w_dense), (two, w_sparse)])
    return fusion.ranked(fused.withColumn("_s", F.round("score", 12)), "_s").drop("_s")


@query(_HYBRID.format("0.6", "0.4") + "SELECT qid, doc_id, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM fr WHERE rank <= 10")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RRF1, JN2, WN1, TK3: dense and BM25 ranks fused."""
    return _hybrid(spark, sf_dir, 0.6, 0.4).filter("rank <= 10").select("qid", "doc_id", F.round("score", 9).alias("score"), "rank")


@query(_HYBRID.format("1.0", "0.0") + "SELECT qid, doc_id, round(score, 9) AS score, CAST(rank AS INTEGER) AS rank FROM fr WHERE rank <= 10")
def rrf_dense_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RRF1 with all weight on one list gives that list's order."""
    return _hybrid(spark, sf_dir, 1.0, 0.0).filter("rank <= 10").select("qid", "doc_id", F.round("score", 9).alias("score"), "rank")


@query(_HYBRID.format("0.6", "0.4") + "SELECT qid, round(avg(score), 9) AS confidence, count(*) AS n FROM fr WHERE rank <= 10 GROUP BY qid")
def hybrid_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG40."""
    return _hybrid(spark, sf_dir, 0.6, 0.4).filter("rank <= 10").groupBy("qid").agg(F.round(F.avg("score"), 9).alias("confidence"), F.count(F.lit(1)).alias("n"))


_TOP = f"WITH {_DENSE}, t AS (SELECT qid, vec_id AS doc_id, score, CAST(rank AS INTEGER) AS rank FROM dr WHERE rank <= 12)"


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense(spark, sf_dir, 12).select("qid", F.col("vec_id").alias("doc_id"), "score", "rank")


@query(_TOP + """, r AS (SELECT *, 0.65 * score + 0.35 * ((doc_id % 7) / 7.0) AS fused FROM t)
SELECT qid, doc_id, round(fused, 6) AS fused, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(fused, 9) DESC, doc_id) AS INTEGER) AS place FROM r""")
def rerank_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RRK1, TK4: (1 - w) base + w rerank, with a stand-in for the cross-encoder's score."""
    r = _top(spark, sf_dir).withColumn("fused", 0.65 * F.col("score") + 0.35 * ((F.col("doc_id") % 7) / 7.0))
    return fusion.ranked(r.withColumn("_f", F.round("fused", 9)), "_f", name="place").select("qid", "doc_id", F.round("fused", 6).alias("fused"), "place")


@query(_TOP + """, n AS (SELECT *, rank - 1 AS r, count(*) OVER (PARTITION BY qid) AS n FROM t)
SELECT qid, doc_id, CAST(CASE WHEN n <= 2 THEN r WHEN r % 2 = 0 THEN r // 2 ELSE n - 1 - (r - 1) // 2 END + 1 AS INTEGER) AS place FROM n""")
def lost_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN4."""
    return fusion.lost_in_middle(_top(spark, sf_dir)).select("qid", "doc_id", "place")


@query(_TOP + """, m AS (SELECT *, max(score) OVER (PARTITION BY qid) AS best FROM t),
k AS (SELECT *, doc_id % 10 = 3 OR score >= 0.35 * best OR best <= 0 AS keep FROM m),
s AS (SELECT *, count(*) FILTER (keep) OVER (PARTITION BY qid) AS kept, row_number() OVER (PARTITION BY qid, keep ORDER BY rank) AS nth FROM k)
SELECT qid, doc_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY keep DESC, rank) AS INTEGER) AS place FROM s WHERE keep OR nth <= 4 - kept""")
def rerank_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIL9, CUT1: relative cutoff with exemptions and backfill."""
    return fusion.cutoff(_top(spark, sf_dir), 0.35, 4, F.col("doc_id") % 10 == 3).select("qid", "doc_id", "place")


@query(_TOP + ", c AS (SELECT * FROM t WHERE rank <= qid // 100 + 1) SELECT qid, round(sum(score * CASE WHEN qid < 100 THEN 1 WHEN qid < 200 THEN [0.7, 0.3][rank] ELSE [0.5, 0.3, 0.2][rank] END), 6) AS confidence FROM c WHERE rank <= 3 GROUP BY qid")
def confidence_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG38, on one, two, three and more results."""
    c = fusion.confidence_top3(_top(spark, sf_dir).filter(F.col("rank") <= F.floor(F.col("qid") / 100) + 1))
    return c.select("qid", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {_DENSE}, {_BM25}, a AS (SELECT qid, max(score) AS d FROM dr WHERE rank <= 20 GROUP BY qid), b AS (SELECT qid, max(score) AS s FROM br GROUP BY qid) SELECT qid, round(0.4 * d + 0.3 * coalesce(s, 0) + 0.3 / (1 + exp(0)), 6) AS confidence FROM a LEFT JOIN b USING (qid)")
def ensemble_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG39, for each query; without a re-ranker its part is that of a score of zero."""
    a = dense(spark, sf_dir, 20).groupBy("qid").agg(F.max("score").alias("d"))
    b = sparse(spark, sf_dir, 1).groupBy("qid").agg(F.max("score").alias("s"))
    both = a.join(b, "qid", "left").select("qid", "d", F.coalesce("s", F.lit(0.0)).alias("s"))
    return both.select("qid", F.round(fusion.ensemble_confidence(F.col("d"), F.col("s"), F.lit(None).cast("double")), 6).alias("confidence"))


@query("""WITH d AS (SELECT doc_id, source, text, 1.0 / (1 + doc_id % 9) AS base, ['the', 'and', 'thon'] AS q FROM documents)
SELECT doc_id, round(least(1.0, base + CASE WHEN len(list_filter(q, lambda w: contains(lower(text), w))) >= 0.7 * len(q) THEN 0.1 ELSE 0 END + CASE WHEN source = 'src0' THEN 0.05 ELSE 0 END), 6) AS score FROM d""")
def keyword_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BST1."""
    d = table(spark, sf_dir, "documents").withColumn("base", 1.0 / (1 + F.col("doc_id") % 9))
    asked = F.array(F.lit("the"), F.lit("and"), F.lit("thon"))
    return d.select("doc_id", F.round(fusion.keyword_boost(F.col("text"), asked, F.col("base"), F.col("source") == "src0"), 6).alias("score"))


@query(_TOP + """, x AS (SELECT qid, doc_id, doc_id AS ord FROM (SELECT DISTINCT qid FROM t), (SELECT doc_id FROM documents WHERE doc_id IN (0, 5, 9, 100, 200))),
n AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY ord, doc_id) AS r FROM x ANTI JOIN t USING (qid, doc_id)),
b AS (SELECT qid, doc_id, true AS injected, r FROM n WHERE r <= 2 UNION ALL SELECT qid, doc_id, false, rank FROM t),
p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY injected DESC, r) AS place FROM b)
SELECT qid, doc_id, injected, CAST(place AS INTEGER) AS place FROM p WHERE place <= 8""")
def booster_inject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN11, ST-U3, TK8: up to two rule documents go in front and the limit grows with them."""
    t = _top(spark, sf_dir)
    extra = table(spark, sf_dir, "documents").filter(F.col("doc_id").isin(0, 5, 9, 100, 200)).select("doc_id", F.col("doc_id").alias("ord"))
    pairs = t.select("qid").distinct().crossJoin(extra)  # a handful of rule documents per query
    return fusion.inject(t, pairs, 2).filter("place <= 8")


@query(_TOP + " SELECT qid, doc_id, rank FROM t WHERE rank <= 5 OR doc_id % 4 = 1")
def topk_exempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN2."""
    return fusion.top_k_exempt(_top(spark, sf_dir), 5, F.col("doc_id") % 4 == 1).select("qid", "doc_id", "rank")


@query("SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS l_partkey, min(l_linenumber) AS l_linenumber FROM lineitem WHERE l_orderkey IN (1, 5, 7, 42, 99999999) GROUP BY l_orderkey")
def fetch_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC12, SRC20, JN1: a point read that reaches the scan as an IN filter; of several rows of an id the first."""
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return filters.first_rows(t, [1, 5, 7, 42, 99999999], "l_orderkey", ["l_linenumber", "l_partkey"])


@query("""WITH v AS (SELECT doc_id, doc_id % 3 AS variant, CAST(n_chars AS DOUBLE) / 1000 AS score, source AS k FROM documents),
b AS (SELECT k, max(score) AS score FROM v GROUP BY k), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, k) AS rank FROM b)
SELECT k, score, CAST(rank AS INTEGER) AS rank, round((SELECT avg(score) FROM v), 6) AS confidence FROM r WHERE rank <= 10""")
def multi_variant_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG1: the best score per key over all variants; confidence is the mean before keys are merged."""
    v = table(spark, sf_dir, "documents").select(F.col("source").alias("k"), (F.col("n_chars").cast("double") / 1000).alias("score"))
    best = v.groupBy("k").agg(F.max("score").alias("score"), F.sum("score").alias("s"), F.count("score").alias("n"))
    every = best.agg(F.round(F.sum("s") / F.sum("n"), 6).alias("confidence"))
    top = best.orderBy(F.desc("score"), "k").limit(10)
    ranked = fusion.ranked(top.withColumn("q", F.lit(1)), qid="q", item="k")
    return ranked.crossJoin(F.broadcast(every)).select("k", "score", "rank", "confidence")  # one row
