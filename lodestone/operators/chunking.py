"""Splitting, cleaning and linking texts (FIL14, FIL16, TF4, WN5-WN7, AG47, STM9); profiles.py cuts documents into chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import rules

def linked(df: DataFrame, doc_id: str = "doc_id", order: str = "chunk_id", item: str = "id") -> DataFrame:
    """prev_chunk_id and next_chunk_id within a document, empty at its ends (WN5, JN8)."""
    w = Window.partitionBy(doc_id).orderBy(order)
    return df.withColumns({"prev_chunk_id": F.coalesce(F.lag(item).over(w), F.lit("")), "next_chunk_id": F.coalesce(F.lead(item).over(w), F.lit(""))})


def paragraphs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, pos (from 0), paragraph: texts cut at blank lines, parts stripped, empty ones left out (TF4)."""
    parts = F.filter(F.transform(F.split(text, r"(?U)\n\s*\n"), rules.stripped), lambda p: p != "")
    return docs.select(doc_id, F.posexplode(parts).alias("pos", "paragraph"))


def without_boilerplate(docs: DataFrame, times: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with each text cleaned as a legal one, and `legal`: whether it has headings (FIL14, FN4).

    Lines are stripped and blank ones go. What heads or foots pages goes, and so do lines that a document has `times`
    times or more, unless they are headings. The rest is written as Markdown, with a blank line before each heading. A null text
    stays null.

    Counting and filtering stay inside each row, as arrays; nothing is shuffled. A line that occurs often enough equals
    the one times - 1 places on among the sorted lines.
    """
    # Each array is named twice by what uses it: so it is computed once a row, not once an element.
    split = docs.withColumn("_lines", F.filter(F.transform(F.split(text, rules.LINE_END, -1), rules.stripped), lambda x: x != ""))
    ordered = split.withColumn("_sorted", F.sort_array("_lines"))
    again = F.filter("_sorted", lambda x, i: x == F.get("_sorted", i + (times - 1)))
    found = ordered.withColumn("_often", F.when(F.size("_sorted") >= times, F.array_distinct(again)).otherwise(F.slice("_sorted", 1, 0)))
    often = F.filter("_lines", lambda x: ~rules.header_footer(x) & (~F.array_contains("_often", x) | rules.legal_heading(x)))
    kept = found.withColumn("_kept", F.when(F.size("_often") > 0, often).otherwise(F.filter("_lines", lambda x: ~rules.header_footer(x))))
    told = F.transform("_kept", lambda x, i: F.concat(F.when(rules.legal_heading(x) & (i > 0), "\n").otherwise(""), rules.legal_line(x)))
    out = kept.withColumn("legal", F.coalesce(F.exists("_kept", rules.legal_heading), F.lit(False)))
    return out.withColumn(text, F.array_join(told, "\n")).drop("_lines", "_sorted", "_often", "_kept")


def validated(df: DataFrame, least_text: int = 10) -> DataFrame:
    """df with `errors`: the names of the rules a chunk breaks (FIL16). Columns: id, doc_id, chunk_id, text, source."""
    rules = [
        ("id", F.col("id").isNull()),
        ("doc_id", F.col("doc_id").isNull()),
        ("chunk_id", F.col("chunk_id").isNull() | (F.col("chunk_id") < 0)),
        ("text", F.col("text").isNull() | (F.length("text") < least_text)),
        ("source", F.col("source").isNull()),
    ]
    return df.withColumn("errors", F.array_compact(F.array(*[F.when(broken, name) for name, broken in rules])))


def spans(df: DataFrame, doc_id: str = "doc_id", order: str = "pos", length: Column | None = None) -> DataFrame:
    """df with start and end_: given offsets (column `offset`) as they are, others by a cursor that only rows without an
    offset advance (WN6)."""
    n = length if length is not None else F.length("line")
    own = F.when(F.col("offset").isNull(), n).otherwise(0)
    before = Window.partitionBy(doc_id).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce("offset", F.sum(own).over(before), F.lit(0))
    return df.withColumn("start", start.cast("long")).withColumn("end_", (F.col("start") + n).cast("long"))


def iou(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, iou: characters that spans (key, start, end_) of both sides cover over those that either covers (AG47).

    A sweep over span ends; positions are never listed one by one.
    """
    ends = lambda df, x, y: df.filter("end_ > start").select(key, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(x).alias("da"), F.lit(y).alias("db")), F.struct(F.col("end_").alias("at"), F.lit(-x).alias("da"), F.lit(-y).alias("db")))).alias("e")).select(key, "e.*")
    steps = ends(a, 1, 0).unionAll(ends(b, 0, 1)).groupBy(key, "at").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    w = Window.partitionBy(key).orderBy("at")
    open_ = steps.select(key, (F.lead("at").over(w) - F.col("at")).alias("n"), (F.sum("da").over(w) > 0).alias("a"), (F.sum("db").over(w) > 0).alias("b"))
    both, either = F.sum(F.when(F.col("a") & F.col("b"), F.col("n"))), F.sum(F.when(F.col("a") | F.col("b"), F.col("n")))
    return open_.groupBy(key).agg((F.coalesce(both, F.lit(0)) / either).alias("iou"))


def streaks(df: DataFrame, low: Column, order: list[str], key: str, least: int = 3) -> DataFrame:
    """df with `streak` (low rows in a row so far) and `escalate` (least or more) (WN7, STM7)."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = df.withColumn("_low", low).withColumn("_island", F.sum((~F.col("_low")).cast("int")).over(w))
    inside = Window.partitionBy(key, "_island").orderBy(*order)
    streak = F.when(F.col("_low"), F.sum(F.col("_low").cast("int")).over(inside)).otherwise(0)
    return marked.withColumn("streak", streak.cast("long")).withColumn("escalate", F.col("streak") >= least).drop("_low", "_island")


def pieces(text: str, most: int = 40, reach: int = 30) -> list[str]:
    """A text cut for streaming: at most `most` characters, after a space or sentence mark from `reach` on if there is one.

    Joined, the pieces are the text (STM9, TF7).
    """
    out, at = [], 0
    while at < len(text):
        part = text[at : at + most]
        if at + most < len(text):
            cut = max((part.rfind(c) for c in " \n.,;!?"), default=-1)
            part = part[: cut + 1] if cut + 1 >= most - reach else part
        out.append(part)
        at += len(part)
    return out
