"""Chunk tables as Parquet folders: create, overwrite, append, bootstrap, and all chunks of a document (SNK2, SNK7, SRC10, SRC21)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table is there, on whatever file system the path names (SRC10)."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def write(df: DataFrame, path: str, mode: str = "create") -> None:
    """mode: `create` (an error if the table exists), `overwrite` or `append`; appended columns go by name (SNK2)."""
    if mode not in ("create", "overwrite", "append"):
        raise ValueError(mode)
    spark = df.sparkSession
    if mode == "append" and exists(spark, path):
        df = df.select(*[F.col(f"`{c}`") for c in spark.read.parquet(path).columns])
    df.write.mode("errorifexists" if mode == "create" else mode).parquet(path)


def bootstrap(spark: SparkSession, path: str, schema: T.StructType | str, force: bool = False) -> str:
    """An empty table with the schema: `created`, `exists` (left as it is) or, with force, `recreated` (SNK7)."""
    there = exists(spark, path)
    if there and not force:
        return "exists"
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    return "recreated" if there else "created"


def chunks_of(table: DataFrame, doc_id: object, key: str = "doc_id", order: str = "chunk_id") -> DataFrame:
    """All chunks of a document in order; the filter reaches the scan (SRC21)."""
    return table.filter(F.col(key) == doc_id).orderBy(order)
