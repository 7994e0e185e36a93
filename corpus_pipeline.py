"""The corpus pipeline: quality filter, line dedup, near-dedup, decontamination and packing of `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as Parquet and gives it,
read back, to the next one. All stages but the last return the columns that they were given, which are those of
`documents`; `n_chars` follows the text where lines were removed. Further columns, whatever their names, are passed on
as they are, repeated rows are treated alike, texts are read whole, however long, and empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontamination, line_dedup, packing, quality, simhash
from lodestone.llm.common import numbered_columns, staged, table
from lodestone.llm.queries import tokenizer_path


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (op 10) scores under one half go; labels of its held-out fold aren't learnt.

    Null and empty texts have scores like any others, and a null doc_id is no reason to go.
    """
    machine = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, machine).filter("score >= 0.5").drop("score").toDF(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines similar to an earlier line (op 3) go; a text of which nothing is left stays, as an empty one.

    Null texts stay null. A null doc_id counts as the largest, so its lines are the later ones.
    """
    plain, at = numbered_columns(line_dedup.without_repeats(docs))
    n = at["n_chars"]
    return plain.withColumn(n, F.length(at["text"]).cast(plain.schema[n].dataType)).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are near copies (shingles of five words), the one with the smallest doc_id stays.

    Near copies are connected by SimHash fingerprints that differ in at most 4 bits (op 8), or by an exact Jaccard
    similarity of 0.8 or more, which 4 bits alone would often miss. Texts that say nothing (no words) are one such group. Rows that share a doc_id stay or go together.
    """
    kept = simhash.near_duplicates(docs, shingle=5, bits=4, similar=(4, 5)).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept")).distinct()
    plain, at = numbered_columns(docs)
    return plain.join(kept, F.col(at["doc_id"]).eqNullSafe(F.col("_kept")), "left_semi").toDF(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item (op 7) go; null and empty texts hold none. Rows that share a doc_id go together, and those
    without one too."""
    found = decontamination.find_items(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_found")).distinct()
    plain, at = numbered_columns(docs)
    return plain.join(found, F.col(at["doc_id"]).eqNullSafe(F.col("_found")), "left_anti").toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, tokenised and packed into sequences of 2,048 tokens (op 6). A null text is an empty one; repeated rows are packed each."""
    return packing.best_fit(docs, tokenizer_path(), capacity=2048)


STAGES = [
    ("quality_filter", quality_filter),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: A trained classifier and fingerprints aren't SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the whole of `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
