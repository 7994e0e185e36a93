"""Queries of graph building and personalised PageRank: customers' and suppliers' nations and regions as a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import fusion, graph
from lodestone.plans.registry import query, table

KINDS = ("NATION", "REGION")
_NODES = """
nodes0 AS (
  SELECT c_custkey AS ord, 'NATION:' || n_name AS node_id, n_name AS text, 'NATION' AS entity_type, 'c' || CAST(c_custkey % 97 AS VARCHAR) AS c
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL
  SELECT 1000000000 + s_suppkey, 'NATION:' || n_name, lower(n_name), 'NATION', 's' || CAST(s_suppkey % 31 AS VARCHAR) FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL
  SELECT 2000000000 + n_nationkey, 'REGION:' || r_name, r_name, 'REGION', 'n' || CAST(n_nationkey AS VARCHAR) FROM nation JOIN region ON n_regionkey = r_regionkey),
edges0 AS (
  SELECT 'NATION:' || n_name AS head, 'IN' AS relation, 'REGION:' || r_name AS tail, 1.0 AS weight, 'c' || CAST(c_custkey % 97 AS VARCHAR) AS c
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT 'REGION:' || r_name, 'HAS', 'NATION:' || n_name, 0.5, 'n' || CAST(n_nationkey AS VARCHAR) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 <> 0
  UNION ALL
  SELECT 'NATION:' || n_name, 'IN', '', 1.0, 'x' FROM nation),
nodes1 AS (
  SELECT node_id, arg_min(text, ord) AS text, arg_min(entity_type, ord) AS entity_type, list_sort(list_distinct(list(c))) AS chunk_ids FROM nodes0 GROUP BY node_id),
edges1 AS (
  SELECT head, relation, tail, sum(weight) AS weight, list_sort(list_distinct(list(c))) AS chunk_ids FROM edges0 WHERE head <> '' AND tail <> '' GROUP BY ALL),
flat AS (SELECT head, tail, sum(weight) AS weight FROM edges1 GROUP BY ALL)
"""


def raw_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    c = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    s = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    r = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    row = lambda ord_, kind, name, text, c: [ord_.cast("long").alias("ord"), F.concat(F.lit(f"{kind}:"), name).alias("node_id"), text.alias("text"), F.lit(kind).alias("entity_type"), F.array(c).alias("chunk_ids")]
    name = F.col("n_name")
    return (
        c.select(*row(F.col("c_custkey"), "NATION", name, name, F.concat(F.lit("c"), (F.col("c_custkey") % 97).cast("string"))))
        .unionAll(s.select(*row(F.col("s_suppkey") + 1_000_000_000, "NATION", name, F.lower("n_name"), F.concat(F.lit("s"), (F.col("s_suppkey") % 31).cast("string")))))
        .unionAll(r.select(*row(F.col("n_nationkey").cast("long") + 2_000_000_000, "REGION", F.col("r_name"), F.col("r_name"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")))))
    )


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    r = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf_dir, "customer").join(r, F.col("c_nationkey") == F.col("n_nationkey"))
    n, g = F.concat(F.lit("NATION:"), F.col("n_name")), F.concat(F.lit("REGION:"), F.col("r_name"))
    row = lambda h, rel, t, w, c: [h.alias("head"), F.lit(rel).alias("relation"), t.alias("tail"), F.lit(w).alias("weight"), F.array(c).alias("chunk_ids")]
    return (
        c.select(*row(n, "IN", g, 1.0, F.concat(F.lit("c"), (F.col("c_custkey") % 97).cast("string"))))
        .unionAll(r.filter("n_nationkey % 3 <> 0").select(*row(g, "HAS", n, 0.5, F.concat(F.lit("n"), F.col("n_nationkey").cast("string")))))
        .unionAll(nation.select(*row(n, "IN", F.lit(""), 1.0, F.lit("x"))))
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.merge_nodes(raw_nodes(spark, sf_dir))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.merge_edges(raw_edges(spark, sf_dir))


@query(f"WITH {_NODES} SELECT * FROM nodes1")
def kg_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG2."""
    return nodes(spark, sf_dir)


@query(f"WITH {_NODES} SELECT head, relation, tail, CAST(weight AS DOUBLE) AS weight, chunk_ids FROM edges1")
def kg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG3."""
    return edges(spark, sf_dir)


@query(f"WITH {_NODES} SELECT head, tail, CAST(weight AS DOUBLE) AS weight FROM flat")
def kg_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG5."""
    return graph.collapse(edges(spark, sf_dir))


@query(f"WITH {_NODES}, two AS (SELECT * FROM edges1 UNION ALL SELECT tail, relation, head, 2.0, ['new'] FROM edges1 UNION ALL SELECT head, relation, tail, 1.0, ['new'] FROM edges1) SELECT head, relation, tail, CAST(sum(weight) AS DOUBLE) AS weight, list_sort(list_distinct(flatten(list(chunk_ids)))) AS chunk_ids FROM two GROUP BY ALL")
def kg_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG4, ST-U4, STM5: two graphs merged; an edge without a weight counts 1."""
    e = edges(spark, sf_dir)
    new = F.array(F.lit("new")).alias("chunk_ids")
    back = e.select(F.col("tail").alias("head"), "relation", F.col("head").alias("tail"), F.lit(2.0).alias("weight"), new)
    again = e.select("head", "relation", "tail", F.lit(None).cast("double").alias("weight"), new)
    return graph.merge_edges(e.unionByName(back).unionByName(again))


@query(f"""WITH {_NODES}, deg AS (SELECT n, count(*) AS d FROM (SELECT head AS n FROM edges1 UNION ALL SELECT tail FROM edges1) GROUP BY n)
SELECT (SELECT count(*) FROM nodes1) AS nodes, (SELECT count(*) FROM edges1) AS edges, 2.0 * (SELECT count(*) FROM edges1) / (SELECT count(*) FROM nodes1) AS avg_degree, (SELECT max(d) FROM deg) AS max_degree""")
def kg_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG6."""
    return graph.statistics(nodes(spark, sf_dir), edges(spark, sf_dir))


@query(f"WITH {_NODES} SELECT c AS chunk_id, list_sort(list(node_id)) AS node_ids FROM (SELECT node_id, unnest(chunk_ids) AS c FROM nodes1) GROUP BY c")
def entity_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK6, JN12: the index from chunks to their entities."""
    return nodes(spark, sf_dir).select("node_id", F.explode("chunk_ids").alias("chunk_id")).groupBy("chunk_id").agg(F.sort_array(F.collect_list("node_id")).alias("node_ids"))


_ROUNDS = 10
_PPR = _NODES + """,
sh AS (SELECT head, tail, weight / sum(weight) OVER (PARTITION BY head) AS share FROM flat),
p AS (SELECT node_id, CASE WHEN node_id IN ('NATION:NATION_3', 'NATION:NATION_7') THEN 1.0 / 2 ELSE 0.0 END AS p, node_id NOT IN (SELECT head FROM flat) AS dangling FROM nodes1),
x0 AS (SELECT node_id, p, dangling, CAST(1 AS DOUBLE) / (SELECT count(*) FROM nodes1) AS score FROM p)
""" + "".join(
    f""", x{i} AS (
  SELECT x.node_id, x.p, x.dangling, 0.85 * (coalesce(f.s, 0) + (SELECT coalesce(sum(score), 0) FROM x{i - 1} WHERE dangling) * x.p) + 0.15 * x.p AS score
  FROM x{i - 1} x LEFT JOIN (SELECT tail, sum(score * share) AS s FROM x{i - 1} JOIN sh ON node_id = head GROUP BY tail) f ON f.tail = x.node_id)"""
    for i in range(1, _ROUNDS + 1)
)


def _ppr(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = nodes(spark, sf_dir).persist()
    seeds = spark.createDataFrame([("NATION:NATION_3",), ("NATION:NATION_7",), ("NATION:NOWHERE",)], "node_id string")
    return n, graph.pagerank(n, graph.collapse(edges(spark, sf_dir)).persist(), seeds, rounds=_ROUNDS, tolerance=None)




@query(f"WITH {_PPR} SELECT node_id, round(score, 9) AS score FROM x{_ROUNDS}")
def ppr_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PPR1 with a fixed number of rounds."""
    return _ppr(spark, sf_dir)[1].select("node_id", F.round("score", 9).alias("score"))


_CHUNKS = _PPR + f""", cs AS (SELECT c AS chunk_id, sum(score) AS s FROM (SELECT node_id, unnest(chunk_ids) AS c FROM nodes1) JOIN x{_ROUNDS} USING (node_id) GROUP BY c),
ch AS (SELECT chunk_id, s / (SELECT max(s) FROM cs) AS ppr FROM cs)"""


@query(f"WITH {_CHUNKS} SELECT chunk_id, round(ppr, 9) AS ppr FROM ch")
def ppr_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG7, JN7."""
    n, x = _ppr(spark, sf_dir)
    return graph.chunk_scores(x, n).select("chunk_id", F.round("ppr", 9).alias("ppr"))


@query(f"WITH {_CHUNKS} SELECT chunk_id, round(ppr, 9) AS ppr, CAST(row_number() OVER (ORDER BY round(ppr, 12) DESC, chunk_id) AS INTEGER) AS rank FROM ch WHERE chunk_id NOT LIKE 'c%' QUALIFY row_number() OVER (ORDER BY round(ppr, 12) DESC, chunk_id) <= 5")
def ppr_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN4: the five best chunks by graph score that the baseline lacks."""
    n, x = _ppr(spark, sf_dir)
    ppr = graph.chunk_scores(x, n).select(F.lit(1).alias("qid"), "chunk_id", F.round("ppr", 12).alias("ppr"))
    baseline = ppr.filter(F.col("chunk_id").startswith("c")).select("qid", "chunk_id")
    return graph.expand(baseline, ppr, 5).select("chunk_id", F.round("ppr", 9).alias("ppr"), "rank")


@query(f"WITH {_CHUNKS}, b AS (SELECT 'c' || CAST(doc_id AS VARCHAR) AS chunk_id, n_chars / (SELECT max(n_chars) FROM documents) AS score FROM documents) SELECT chunk_id, round(0.6 * score + 0.4 * coalesce(ppr, 0), 6) AS fused FROM b LEFT JOIN ch USING (chunk_id)")
def graph_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN3, FUS1: base scores over their maximum, fused with graph scores."""
    n, x = _ppr(spark, sf_dir)
    ppr = graph.chunk_scores(x, n).select(F.lit(1).alias("qid"), F.col("chunk_id").alias("doc_id"), "ppr")
    docs = table(spark, sf_dir, "documents")
    base = docs.select(F.lit(1).alias("qid"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("doc_id"), F.col("n_chars").cast("double").alias("score"))
    base = base.withColumn("score", fusion.max_normalised("score"))
    return fusion.graph_fused(base, ppr).select(F.col("doc_id").alias("chunk_id"), F.round("fused", 6).alias("fused"))


@query("""WITH s AS (SELECT c_custkey % 20 AS qid, CASE WHEN c_custkey % 3 = 0 THEN 'NATION:' ELSE 'OTHER:' END || CAST(c_nationkey % (1 + c_custkey % 20) AS VARCHAR) AS node_id FROM customer),
n AS (SELECT qid, count(DISTINCT node_id) FILTER (split_part(node_id, ':', 1) IN ('NATION', 'REGION')) AS n FROM s GROUP BY qid)
SELECT qid, CAST(CASE WHEN n >= 2 THEN 8 ELSE 5 END AS INTEGER) AS m, CAST(CASE WHEN n >= 2 THEN 8 ELSE 5 END AS INTEGER) AS k FROM n""")
def comparison_widen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN3."""
    c = table(spark, sf_dir, "customer")
    kind = F.when(F.col("c_custkey") % 3 == 0, "NATION:").otherwise("OTHER:")
    seeds = c.select((F.col("c_custkey") % 20).alias("qid"), F.concat(kind, (F.col("c_nationkey") % (1 + F.col("c_custkey") % 20)).cast("string")).alias("node_id"))
    return graph.widened(seeds, 5, 5, KINDS)
