"""Readers and writers of records, whole files and graphs (SRC1-7, SNK1, SNK3, SNK6, SNK8, SNK9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "doc_id string, id string, chunk_id int, text string, text_plain string, summary string, source string, faq_type string, metadata map<string,string>"


def read_records(spark: SparkSession, path: str, schema: str = RECORD, but: str | None = None, glob: str = "*.jsonl") -> DataFrame:
    """Records of JSONL files, line by line: blank, undecodable and other lines are dropped, a bare string becomes a record
    of its text; `file` and `line` say where from. Files whose name contains `but` are left out (SRC1, SRC2, SRC5)."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    raw = raw.select(F.col("value"), F.col("_metadata.file_path").alias("file")).filter(F.trim("value") != "")
    if but is not None:
        raw = raw.filter(~F.contains(F.element_at(F.split("file", "/"), -1), F.lit(but)))
    kind = F.when(F.trim("value").startswith("{"), "object").when(F.trim("value").startswith('"'), "string")
    whole = F.try_parse_json("value").isNotNull()
    told = raw.withColumn("kind", kind).filter(F.col("kind").isNotNull() & whole)
    parsed = told.withColumn("r", F.from_json("value", schema)).withColumn("s", F.when(F.col("kind") == "string", F.try_variant_get(F.try_parse_json("value"), "$", "string")))
    name = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.jsonl$", "")
    fields = [f.name for f in told.sparkSession.createDataFrame([], schema).schema.fields]
    own = {"doc_id": name, "id": name, "chunk_id": F.lit(0), "text": F.col("s")}
    columns = [F.when(F.col("kind") == "string", own[c]).otherwise(F.col(f"r.{c}")).alias(c) if c in own else F.col(f"r.{c}").alias(c) for c in fields]
    return parsed.select(*columns, "file")


def read_chunks(spark: SparkSession, path: str, **options) -> DataFrame:
    """Records for a vector or graph build: id is `id`, else `chunk_id`; text is text_plain, else text; none empty (SRC3, SRC4)."""
    r = read_records(spark, path, **options)
    text = F.coalesce(F.nullif(F.col("text_plain"), F.lit("")), F.col("text"))
    return r.withColumn("id", F.coalesce("id", F.col("chunk_id").cast("string"), F.concat(F.lit("chunk_"), F.substring(F.sha1(F.col("text").cast("binary")), 1, 12)))).withColumn("text", text).filter(F.trim("text") != "")


def read_whole(spark: SparkSession, path: str, glob: str = "*.{txt,md}") -> DataFrame:
    """file, text: whole text files, bytes that aren't UTF-8 replaced (SRC6, SRC7)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return raw.select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("text"))


def manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """file, size, sha256 of each file (SNK3, SNK8)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return raw.select(F.col("path").alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def write_records(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSONL (SNK1); snapshots refuse to overwrite by default (SNK8)."""
    df.write.mode(mode).json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """nodes and edges as two Parquet tables (SNK6)."""
    nodes.write.mode(mode).parquet(f"{path}/nodes")
    edges.write.mode(mode).parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def delete_by_id(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """df without the given ids, to be written to a new path (SNK9)."""
    return df.join(ids.select(key), key, "left_anti")
