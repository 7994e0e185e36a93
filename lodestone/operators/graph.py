"""Knowledge graphs as two tables: build, merge, collapse, statistics and personalised PageRank (AG2-7, PPR1, JN4, JN7, WN3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import cut


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """node_id, text, entity_type, chunk_ids: one row per node_id; text and type of its first row by `ord`, chunk ids united.

    nodes: ord, node_id, text, entity_type, chunk_ids. The union is a grouped set over exploded ids, so a node that a
    third of all chunks name is pre-aggregated like any other.
    """
    head = nodes.groupBy("node_id").agg(F.min_by("text", "ord").alias("text"), F.min_by("entity_type", "ord").alias("entity_type"))
    ids = nodes.select("node_id", F.explode("chunk_ids").alias("c")).distinct().groupBy("node_id").agg(F.sort_array(F.collect_list("c")).alias("chunk_ids"))
    return head.join(ids, "node_id", "left")


def merge_edges(edges: DataFrame) -> DataFrame:
    """head, relation, tail, weight, chunk_ids: weights of equal edges add up, chunk ids are united; empty ends go.

    A missing weight counts 1.
    """
    sound = edges.filter((F.col("head") != "") & (F.col("tail") != ""))
    keys = ["head", "relation", "tail"]
    sums = sound.groupBy(*keys).agg(F.sum(F.coalesce("weight", F.lit(1.0))).alias("weight"))
    ids = sound.select(*keys, F.explode("chunk_ids").alias("c")).distinct().groupBy(*keys).agg(F.sort_array(F.collect_list("c")).alias("chunk_ids"))
    return sums.join(ids, keys, "left")


def collapse(edges: DataFrame) -> DataFrame:
    """head, tail, weight: parallel edges as one."""
    return edges.groupBy("head", "tail").agg(F.sum("weight").alias("weight"))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, avg_degree, max_degree; parallel edges count, a loop counts twice."""
    ends = edges.select(F.col("head").alias("n")).unionAll(edges.select(F.col("tail").alias("n")))
    degree = ends.groupBy("n").agg(F.count(F.lit(1)).alias("d")).agg(F.max("d").alias("most"))
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    m = edges.agg(F.count(F.lit(1)).alias("edges"))
    one = n.crossJoin(m).crossJoin(degree)  # one row each
    average = F.when(F.col("nodes") > 0, 2.0 * F.col("edges") / F.col("nodes")).otherwise(0.0)
    return one.select("nodes", "edges", average.alias("avg_degree"), F.coalesce("most", F.lit(0)).cast("long").alias("max_degree"))


def pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, alpha: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """node_id, score: personalised PageRank on a weighted digraph (collapsed edges: head, tail, weight).

    Mass starts evenly on all nodes, restarts evenly on the distinct seeds that are nodes, and what nodes without
    out-edges hold goes where restarts go. Iterates x' = alpha (W x + dangling p) + (1 - alpha) p until the change is
    below n * tolerance; no seed, or no convergence in `rounds`, gives no rows. With tolerance None, `rounds` rounds
    run without a test. One number a round reaches the driver. Scores, a row per node, are checkpointed each round.
    """
    spark = nodes.sparkSession
    p = nodes.select("node_id").join(seeds.select("node_id").distinct(), "node_id", "left_semi")
    n, k = nodes.count(), p.count()
    empty = spark.createDataFrame([], "node_id string, score double")
    if not n or not k:
        return empty
    out = edges.groupBy("head").agg(F.sum("weight").alias("total"))
    shares = edges.join(out, "head").select("head", "tail", (F.col("weight") / F.col("total")).alias("share")).persist()
    start = nodes.select("node_id").join(p.withColumn("p", F.lit(1.0 / k)), "node_id", "left").join(out.select(F.col("head").alias("node_id"), F.lit(1).alias("has")), "node_id", "left")
    base = start.select("node_id", F.coalesce("p", F.lit(0.0)).alias("p"), F.col("has").isNull().alias("dangling")).persist()
    x = base.select("node_id", "p", "dangling", F.lit(1.0 / n).alias("score"))
    for step in range(1, rounds + 1):
        flow = x.join(shares, x["node_id"] == shares["head"]).groupBy("tail").agg(F.sum(F.col("score") * F.col("share")).alias("in"))
        lost = x.filter("dangling").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("lost"))
        new = x.join(flow, x["node_id"] == flow["tail"], "left").crossJoin(F.broadcast(lost))  # one row
        moved = alpha * (F.coalesce("in", F.lit(0.0)) + F.col("lost") * F.col("p")) + (1 - alpha) * F.col("p")
        x_new = new.select("node_id", "p", "dangling", moved.alias("score"), F.col("score").alias("old"))
        x_new = cut(x_new)  # a round reads it three times; uncut, plans would triple
        x = x_new.drop("old")
        if tolerance is not None and x_new.agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0] < n * tolerance:
            return x.select("node_id", "score")
    return x.select("node_id", "score") if tolerance is None else empty


def chunk_scores(scores: DataFrame, nodes: DataFrame) -> DataFrame:
    """chunk_id, ppr: the scores of a chunk's nodes summed, over the largest sum (AG7, JN7)."""
    sums = nodes.select("node_id", F.explode("chunk_ids").alias("chunk_id")).join(scores, "node_id").groupBy("chunk_id").agg(F.sum("score").alias("s"))
    best = sums.agg(F.max("s").alias("best"))
    return sums.crossJoin(F.broadcast(best)).select("chunk_id", (F.col("s") / F.col("best")).alias("ppr"))  # one row


def expand(baseline: DataFrame, ppr: DataFrame, most: int, qid: str = "qid", item: str = "chunk_id") -> DataFrame:
    """The `most` best chunks by graph score that a query's baseline lacks (JN4)."""
    new = ppr.join(baseline.select(qid, item), [qid, item], "left_anti")
    order = Window.partitionBy(qid).orderBy(F.desc("ppr"), item)
    return new.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def widened(seeds: DataFrame, m: int, k: int, kinds: tuple[str, ...], qid: str = "qid", wide: int = 8, more: int = 3) -> DataFrame:
    """qid, m, k: for queries with two or more distinct seeds of the given kinds, m is `wide` and k grows by `more` (WN3)."""
    hit = F.countDistinct(F.when(F.split_part("node_id", F.lit(":"), F.lit(1)).isin(*kinds), F.col("node_id")))
    many = seeds.groupBy(qid).agg(hit.alias("n"))
    return many.select(qid, F.when(F.col("n") >= 2, wide).otherwise(m).cast("int").alias("m"), F.when(F.col("n") >= 2, k + more).otherwise(k).cast("int").alias("k"))
