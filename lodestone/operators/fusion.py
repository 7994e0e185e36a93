"""Rank fusion, re-ranking, cutoffs, injection and confidence (JN2-4, JN11, FIL9, WN2, WN4, RRK1, BST1, FUS1, AG38-40)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def rrf(lists: list[tuple[DataFrame, float]], k: int = RRF_K, qid: str = "qid", item: str = "doc_id", rank: str = "rank") -> DataFrame:
    """qid, item, score: the sum over the ranked lists of weight / (k + rank). One union, one shuffle."""
    parts = [df.select(qid, item, (F.lit(float(w)) / (k + F.col(rank))).alias("part")) for df, w in lists]
    return reduce(DataFrame.unionByName, parts).groupBy(qid, item).agg(F.sum("part").alias("score"))


def ranked(df: DataFrame, score: str = "score", qid: str = "qid", item: str = "doc_id", name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(qid).orderBy(F.desc(score), item)))


def cutoff(df: DataFrame, ratio: float, least: int, exempt: Column, score: str = "score", qid: str = "qid", rank: str = "rank") -> DataFrame:
    """Rows with a score of `ratio` of the query's best or more, and exempt ones; `place` is their new order.

    A ratio or a best score of zero or less keeps all. If fewer than `least` are kept, the first of the others by rank
    follow at the end.
    """
    every = Window.partitionBy(qid)
    best = F.max(score).over(every)
    keep = F.coalesce(exempt, F.lit(False)) | (F.col(score) >= ratio * best) | (best <= 0) | F.lit(ratio <= 0)
    marked = df.withColumn("_keep", keep)
    kept = F.sum(F.col("_keep").cast("int")).over(every)
    nth = F.row_number().over(Window.partitionBy(qid, "_keep").orderBy(rank))
    marked = marked.withColumn("_kept", kept).withColumn("_nth", nth)
    chosen = marked.filter(F.col("_keep") | (F.col("_nth") <= F.lit(least) - F.col("_kept")))
    return chosen.withColumn("place", F.row_number().over(Window.partitionBy(qid).orderBy(F.desc("_keep"), rank))).drop("_keep", "_kept", "_nth")


def lost_in_middle(df: DataFrame, qid: str = "qid", rank: str = "rank") -> DataFrame:
    """`place` (from 1): ranks 1, 3, 5 .. from the front and 2, 4 .. from the back; two rows or fewer stay."""
    n, r = F.count(F.lit(1)).over(Window.partitionBy(qid)), F.col(rank) - 1
    at = F.when(n <= 2, r).when(r % 2 == 0, r / 2).otherwise(n - 1 - (r - 1) / 2)
    return df.withColumn("place", (at + 1).cast("int"))


def top_k_exempt(df: DataFrame, k: int | Column, exempt: Column, rank: str = "rank") -> DataFrame:
    """The first k, then exempt ones beyond them, in order of rank (WN2)."""
    return df.filter((F.col(rank) <= k) | F.coalesce(exempt, F.lit(False)))


def max_normalised(score: str, qid: str = "qid") -> Column:
    """score over the query's largest, as it is where that is zero or less."""
    best = F.max(score).over(Window.partitionBy(qid))
    return F.when(best > 0, F.col(score) / best).otherwise(F.col(score))


def graph_fused(base: DataFrame, ppr: DataFrame, alpha: float = 0.6, beta: float = 0.4, qid: str = "qid", item: str = "doc_id") -> DataFrame:
    """base with `fused`: alpha of the base score and beta of the graph score (0 if missing); the base score alone for a
    query without any graph score (JN3, FUS1). ppr: qid, item, ppr."""
    some = ppr.select(qid).distinct().withColumn("_some", F.lit(True))
    joined = base.join(ppr.select(qid, item, "ppr"), [qid, item], "left").join(some, qid, "left")
    return joined.withColumn("fused", F.when(F.col("_some"), alpha * F.col("score") + beta * F.coalesce("ppr", F.lit(0.0))).otherwise(F.col("score"))).drop("_some")


def keyword_boost(text: Column, question_words: Column, score: Column, official: Column) -> Column:
    """score + 0.1 if at least 70 % of the distinct query words are in the text, + 0.05 if official; 1 at most (BST1)."""
    distinct = F.array_distinct(question_words)
    hits = F.size(F.filter(distinct, lambda w: F.contains(F.lower(text), w)))
    boost = F.when((F.size(distinct) > 0) & (hits >= 0.7 * F.size(distinct)), 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), score + boost + F.when(official, 0.05).otherwise(0.0))


def confidence_top3(df: DataFrame, score: str = "score", qid: str = "qid", rank: str = "rank") -> DataFrame:
    """qid, confidence: the first score; 0.7 and 0.3 of two; 0.5, 0.3, 0.2 of the first three of more (AG38)."""
    n = F.least(F.count(F.lit(1)).over(Window.partitionBy(qid)), F.lit(3))
    r = F.col(rank)
    weight = F.when(n == 1, 1.0).when(n == 2, F.when(r == 1, 0.7).otherwise(0.3)).otherwise(F.when(r == 1, 0.5).when(r == 2, 0.3).otherwise(0.2))
    weighted = df.withColumn("_w", weight).filter(r <= 3)
    return weighted.groupBy(qid).agg(F.sum(F.col("_w") * F.col(score)).alias("confidence"))


def ensemble_confidence(dense: Column, sparse: Column, rerank: Column) -> Column:
    """0.4 dense + 0.3 sparse + 0.3 sigmoid(rerank) of the largest scores; missing ones count 0 (AG39)."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return 0.4 * z(dense) + 0.3 * z(sparse) + 0.3 / (1 + F.exp(-z(rerank)))


def inject(base: DataFrame, extra: DataFrame, most: int, qid: str = "qid", item: str = "doc_id") -> DataFrame:
    """The first `most` of extra (qid, item, ord) that the base lacks, in front of the base (qid, item, rank); `place`
    numbers both and `injected` tells them apart (JN11)."""
    new = extra.join(base.select(qid, item), [qid, item], "left_anti")
    new = new.withColumn("_n", F.row_number().over(Window.partitionBy(qid).orderBy("ord", item))).filter(F.col("_n") <= most)
    both = new.select(qid, item, F.lit(True).alias("injected"), F.col("_n").alias("_r")).unionByName(base.select(qid, item, F.lit(False).alias("injected"), F.col("rank").alias("_r")))
    return both.withColumn("place", F.row_number().over(Window.partitionBy(qid).orderBy(F.desc("injected"), "_r"))).drop("_r")


def dispatch(base: DataFrame, ppr: DataFrame, routes: DataFrame, k: int, more: dict[str, int] | None = None, alpha: float = 0.6, beta: float = 0.4, qid: str = "qid", item: str = "doc_id") -> DataFrame:
    """qid, item, injected, fused, place: the k best results of each query by its route (RTE1).

    base: qid, item, score; ppr: qid, item, ppr; routes: qid, route. A route in `more` takes so many graph results that
    the base lacks into the pool and fuses (FUS1, JN3); any other route, such as `padded`, keeps the base's order.
    """
    most = F.lit(0)
    for name, m in (more or {"hybrid": 5, "graph": 8}).items():
        most = F.when(F.col("route") == name, m).otherwise(most)
    routed = routes.select(qid, most.alias("_m"))
    new = ppr.join(base.select(qid, item), [qid, item], "left_anti").join(routed.filter("_m > 0"), qid)
    new = new.withColumn("_r", F.row_number().over(Window.partitionBy(qid).orderBy(F.desc("ppr"), item))).filter("_r <= _m")
    pool = new.select(qid, item, F.lit(0.0).alias("score"), F.lit(True).alias("injected")).unionByName(base.select(qid, item, "score", F.lit(False).alias("injected")))
    normal = pool.withColumn("_n", max_normalised("score", qid)).join(ppr.select(qid, item, "ppr"), [qid, item], "left").join(routed, qid)
    fused = F.when(F.col("_m") > 0, alpha * F.col("_n") + beta * F.coalesce("ppr", F.lit(0.0))).otherwise(F.col("score"))
    out = normal.withColumn("fused", fused)
    place = F.row_number().over(Window.partitionBy(qid).orderBy(F.desc(F.round("fused", 12)), item))
    return out.withColumn("place", place).filter(F.col("place") <= k).select(qid, item, "injected", "fused", "place")


def program_limit(df: DataFrame, programme: bool, rank: str = "rank") -> DataFrame:
    """At most fifteen results for a question about programmes, else thirty (TK7)."""
    return df.filter(F.col(rank) <= (15 if programme else 30))
