"""Held-out folds and bounded, balanced-by-hash samples of labelled texts, shared by the two classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import pick

STEPS = 1 << 20


def remainder(doc_id: str, folds: int) -> Column:
    """crc32 of doc_id as text modulo folds; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, text, label of about `most` labelled documents outside the held-out fold, chosen by a hash of doc_id.

    Labels that repeat for a doc_id count once (the larger one); null labels and labels without a document don't
    count. Only the ids chosen (at most about `most`, by the count taken first) are broadcast; texts aren't shuffled.
    """
    known = (
        pick(labels, doc_id=doc_id, label=label)
        .filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", folds) != held))
        .groupBy("doc_id")
        .agg(F.max("label").cast("int").alias("label"))
    )
    n = known.count()
    if n > most:
        known = known.filter(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(STEPS)) < int(most / n * STEPS))
    return pick(docs, doc_id=doc_id, text=text).join(F.broadcast(known), "doc_id")
