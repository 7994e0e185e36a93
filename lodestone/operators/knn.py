"""Exact k-nearest neighbours for batches of queries (KNN1-3, TK1, TK9, SRC11, SRC13)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that are broadcast at most; else, rows of each side in a cell of the grid, and vectors that are multiplied at once.
BLOCK, CELL, STRIP = 2048, 32_768, 2048
FOUND = "qid long, vec_id long, score double"


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product of two arrays in double precision, inside the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def nearest(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", qid: str = "qid", qvec: str = "qvec", vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """qid, vec_id, score, rank: the k best vectors of each query, ties to the smaller vec_id.

    metric: `cosine`, dot over norms with 1e-8 added to each; `l2`, 1 / (1 + squared distance). Each batch of vectors
    is multiplied with a block of queries and keeps its k best, so that only k rows per query and batch are shuffled.
    Queries of another length than the vectors, null or empty ones find nothing (KNN3). Up to BLOCK queries are broadcast;
    more are dealt with the vectors over a grid, on executors alone.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError(metric)
    spark = vectors.sparkSession
    rows = vectors.filter(F.col(vec).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("vec"))
    asked = queries.select(F.col(qid).cast("long").alias("qid"), F.col(qvec).cast("array<double>").alias("qvec")).filter(F.size("qvec") > 0)
    few = asked.limit(BLOCK + 1).collect()
    if len(few) <= BLOCK:
        sent = spark.sparkContext.broadcast([(r[0], r[1]) for r in few])
        best = rows.mapInArrow(_score(sent, k, metric), FOUND)
    else:
        best = _grid(asked, rows, k, metric)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _grid(asked: DataFrame, rows: DataFrame, k: int, metric: str, cell: int | None = None) -> DataFrame:
    """The k best of each query in each cell of a grid: queries and vectors are dealt by hash into strips of about CELL, and a
    cell has one strip of each. Each strip goes to as many cells as the other side has strips, and nothing passes the driver."""
    size = cell or CELL
    across, down = (max(1, -(-df.count() // size)) for df in (asked, rows))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select(own("vec_id", down).alias("v"), every(across).alias("q"), "vec_id", "vec")
    right = asked.select(every(down).alias("v"), own("qid", across).alias("q"), "qid", "qvec")

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        score = _score(None, k, metric, list(zip(queries.column("qid").to_pylist(), queries.column("qvec").to_pylist(), strict=True)))
        parts = [b for batch in vectors.select(["vec_id", "vec"]).to_batches(max_chunksize=STRIP) for b in score(iter([batch]))]
        return pa.Table.from_batches(parts) if parts else pa.table({"qid": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    return left.groupBy("v", "q").cogroup(right.groupBy("v", "q")).applyInArrow(run, FOUND)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, best first, ties to the smaller id; only those no worse than the k-th are sorted."""
    known = np.nan_to_num(scores, nan=-np.inf)
    at = np.flatnonzero(known >= np.partition(known, -k)[-k]) if len(known) > k else np.arange(len(known))
    return at[np.lexsort((ids[at], -known[at]))[:k]]


def _score(sent, k: int, metric: str, own: list | None = None):
    """sent: a broadcast list of (qid, vector), or `own`, the list itself."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size: dict[int, list] = {}
        for q, v in sent.value if own is None else own:
            by_size.setdefault(len(v), []).append((q, v))
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            sizes, flat = np.diff(lists.offsets.to_numpy()), np.asarray(lists.flatten().to_numpy(zero_copy_only=False), float)
            starts = np.cumsum(sizes) - sizes
            out: list[tuple] = []
            for size, asked in by_size.items():
                here = np.flatnonzero(sizes == size)
                if not len(here) or not size:
                    continue
                v = flat[starts[here][:, None] + np.arange(size)] if len(here) < len(sizes) else flat.reshape(len(sizes), size)
                q = np.array([x for _, x in asked], float)
                if metric == "cosine":
                    s = (q / (np.linalg.norm(q, axis=1, keepdims=True) + 1e-8)) @ (v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-8)).T
                else:
                    s = 1 / (1 + np.maximum((q**2).sum(1)[:, None] + (v**2).sum(1)[None] - 2 * q @ v.T, 0))
                for (qid, _), row in zip(asked, s, strict=True):
                    top = _best(row, ids[here], k)
                    out += zip([qid] * len(top), ids[here[top]].tolist(), row[top].tolist(), strict=True)
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["qid", "vec_id", "score"])

    return score
