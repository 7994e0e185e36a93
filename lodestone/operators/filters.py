"""Metadata and time-aware filters, fallbacks and re-scoring (FIL1-FIL7, FIL9, FIL10, FIL12, JN10, JN14, WN8, SNK3, SNK12)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import matching


def _equal(fields: dict, meta: str | None) -> Column:
    value = lambda k: F.coalesce(F.col(k), F.col(meta)[k]) if meta else F.col(k)
    return reduce(lambda a, b: a & b, [value(k) == v for k, v in fields.items()], F.lit(True))


def metadata_filter(df: DataFrame, where: dict, meta: str | None = None) -> DataFrame:
    """Rows that equal `where` in all fields; with `or_conditions` (a list of such) in one of them, and then only those
    count (FIL1, FIL2). A column wins over the metadata map unless it is null; a missing value never equals."""
    groups = where.get("or_conditions")
    if groups:
        return df.filter(reduce(lambda a, b: a | b, [_equal(g, meta) for g in groups]))
    return df.filter(_equal({k: v for k, v in where.items() if k != "or_conditions"}, meta))


def with_fallback(df: DataFrame, condition: Column) -> DataFrame:
    """The filtered rows, or all rows if none passes (FIL12); one pass decides, without an action."""
    some = df.agg(F.coalesce(F.bool_or(condition), F.lit(False)).alias("_some"))
    return df.crossJoin(F.broadcast(some)).filter(condition | ~F.col("_some")).drop("_some")  # one row


def temporal_exclude(df: DataFrame, year: Column, current: int, in_season: bool, has_data: bool, intent: str) -> DataFrame:
    """In season, with data, and for current or ambiguous intents: no rows of earlier years; a null year stays (FIL3)."""
    if not (in_season and has_data and intent in ("current", "ambiguous")):
        return df
    return df.filter(year.isNull() | (year >= current))


def not_superseded(df: DataFrame, superseded: Column, historical: Column) -> DataFrame:
    """Superseded rows go unless the query is historical (FIL4)."""
    return df.filter(~F.coalesce(superseded, F.lit(False)) | historical)


def temporal_distance(distance: Column, year: Column, current: int, requested: int | None = None) -> Column:
    """The requested year's distance as it is, this year's over 1.5 if positive, earlier ones' over 0.7 (FIL5)."""
    out = F.when(year == requested, distance) if requested is not None else F.when(F.lit(False), distance)
    return out.when((year == current) & (distance > 0), distance / 1.5).when(year < current, distance / 0.7).otherwise(distance)


def rules_fired(texts: DataFrame, rules: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, chunk_id, ord: chunks of the rules (ord, pattern, chunk_id) with a pattern that matches the text, each at its
    first place (JN10). Several rows may share an ord; see matching.fired()."""
    own = rules.select(F.xxhash64("ord", "pattern", "chunk_id").alias("_id"), "ord", "pattern", "chunk_id").dropDuplicates(["_id"])
    hits = matching.fired(texts, own.select(F.col("_id").alias("ord"), "pattern"), keys, text).withColumnRenamed("ord", "_id")
    return hits.join(own.select("_id", "ord", "chunk_id"), "_id").groupBy(*keys, "chunk_id").agg(F.min("ord").alias("ord"))


def latest(df: DataFrame, keys: list[str], year: str, order: list[str] | None = None) -> DataFrame:
    """The row of the latest year per key, of several the first by `order` (by all columns if none is named) (JN14).

    An aggregation, not a window, so it combines before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.struct((-F.col(year)).alias("_y"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order or rest)])
    best = df.filter(F.col(year).isNotNull()).groupBy(*keys).agg(F.min_by(F.struct(*rest), first).alias("_r"))
    return best.select(*keys, "_r.*")


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key by order (WN8)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def manifest_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """key, status: added, removed, replaced or unchanged, by digest (SNK3, SRC9, JN18)."""
    o = old.select(key, F.col(digest).alias("_o"))
    both = o.join(new.select(key, F.col(digest).alias("_n")), key, "full")
    status = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") == F.col("_n"), "unchanged").otherwise("replaced")
    return both.select(key, status.alias("status"))


def first_rows(df: DataFrame, ids: list, key: str, order: list[str]) -> DataFrame:
    """The first row by order of each of the given ids that df has (JN1). The ids reach the scan as an IN filter, and rows of
    one id are combined before the exchange."""
    rest = [c for c in df.columns if c != key]
    found = df.filter(F.col(key).isin(ids)).groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return found.select(key, "_r.*")


def append_new(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """incoming rows whose key doesn't exist yet, each key once (SNK3, JN12)."""
    return incoming.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def supersede(df: DataFrame, year: str, flag: str, current: int) -> DataFrame:
    """Rows of earlier years marked as superseded (SNK12)."""
    return df.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)) | (F.col(year) < current))
