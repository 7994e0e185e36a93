"""Texts of a high Jaccard similarity: MinHash bands propose pairs, whole shingle sets decide.

A band is a hash of WIDTH minima; texts that share a band are a candidate pair. At a similarity of 0.8 a pair shares
none of the 24 bands once in about 300,000 times, and less often above it. Only pairs of different components are
looked at: each bucket is first compared with one text of it, whose near copies so become one component, and only then
are the texts of the components that still meet in a bucket compared with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import drop_staged, staged
from lodestone.llm.components import components

BANDS, WIDTH = 24, 4
_odd = lambda name, n: np.array([xxhash.xxh64_intdigest(f"{name}{i}".encode(), 42) | 1 for i in range(n)], np.uint64)
FLIP, TIMES, MIX, START = _odd("flip", BANDS * WIDTH), _odd("times", BANDS * WIDTH), _odd("mix", WIDTH), _odd("start", BANDS)
#: Hashes whose minima are taken at once.
PART = 2048
#: Rounds in which a bucket is compared with one text of it, before all pairs that are left.
STARS = 2


def bands(hashes: np.ndarray) -> np.ndarray:
    """A signed 64-bit key for each band; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * WIDTH, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), PART):
        least = np.minimum(least, ((hashes[None, i : i + PART] ^ FLIP[:, None]) * TIMES[:, None]).min(1))
    return ((least.reshape(BANDS, WIDTH) * MIX).sum(1, dtype=np.uint64) ^ START).view(np.int64)


def merges(texts: DataFrame, docs: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """root, to: which components become one because texts of theirs have a similarity of num/den or more.

    texts: tk (hash of a text), root (its component), size (of its shingle set) and its bands; docs: text.
    """
    known = staged(texts.dropDuplicates(["tk"]), "sketches")
    moves = None
    tested = None
    for turn in range(STARS + 1):
        if moves is None:
            now = known
        else:
            now = known.join(moves, "root", "left").withColumn("root", F.coalesce("to", "root")).drop("to")
        rows = now.select("tk", "root", "size", F.explode("bands").alias("key"))
        lead = F.min_by(F.struct("tk", "root", "size"), F.xxhash64("tk", "key", F.lit(turn))).alias("lead")
        met = staged(rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), lead).filter("low < high").select("key", "lead"), "met")
        x = rows.select("key", *[F.col(c).alias(f"x_{c}") for c in ("tk", "root", "size")])
        if turn < STARS:
            both = x.join(met.select("key", *[F.col(f"lead.{c}").alias(f"y_{c}") for c in ("tk", "root", "size")]), "key")
        else:
            meeting = staged(rows.join(met.select("key"), "key", "left_semi"), "meeting")
            x, y = (meeting.select("key", *[F.col(c).alias(f"{side}_{c}") for c in ("tk", "root", "size")]) for side in "xy")
            both = x.join(y, "key").filter("x_root < y_root")
        alike = F.least("x_size", "y_size") * den >= F.greatest("x_size", "y_size") * num
        turned = F.col("x_tk") < F.col("y_tk")
        ends = [F.when(turned, F.col(f"{p}_{c}")).otherwise(F.col(f"{q}_{c}")).alias(f"{n}{c}") for n, p, q in (("a", "x", "y"), ("b", "y", "x")) for c in ("tk", "root")]
        pairs = both.filter((F.col("x_root") != F.col("y_root")) & alike).select(*ends).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["atk", "btk"], "left_anti")
        pairs = staged(pairs, "pairs")
        links = staged(_verified(pairs, docs, shingle, num, den), "similar")
        drop_staged(met, *([meeting] if turn == STARS else []))
        tested = pairs.select("atk", "btk") if tested is None else tested.unionAll(pairs.select("atk", "btk"))
        if not links.isEmpty():
            found = components(links)
            step = found.select(F.col("node").alias("root"), F.col("root").alias("to"))
            if moves is None:
                moves = staged(step, "moves")
            else:
                older = moves.select(F.col("root").alias("was"), F.col("to").alias("root")).join(step, "root", "left").select(F.col("was").alias("root"), F.coalesce("to", "root").alias("to"))
                moves = staged(older.unionAll(step.join(moves.select("root"), "root", "left_anti")), "moves")
            drop_staged(found)
        drop_staged(links)
    return moves if moves is not None else known.select("root", F.col("root").alias("to")).limit(0)


def _verified(pairs: DataFrame, docs: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """a, b: the components of those pairs whose texts' shingle sets are similar, by exact counts."""
    from lodestone.llm.simhash import shingle_hashes

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(t.as_buffer().to_pybytes(), shingle)).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["tk", "held"])

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                u, v = (np.frombuffer(z.as_buffer(), "<u8") for z in (a, b))
                shared = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(shared * (num + den) >= (len(u) + len(v)) * num)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    ends = pairs.select(F.col("atk").alias("tk")).unionAll(pairs.select(F.col("btk").alias("tk"))).distinct()
    asked = docs.withColumn("tk", F.xxhash64("text")).join(ends, "tk", "left_semi").dropDuplicates(["tk"])
    held = staged(asked.select("tk", "text").mapInArrow(sets, "tk long, held binary"), "sets")
    both = pairs.join(held.select(F.col("tk").alias("atk"), F.col("held").alias("u")), "atk").join(held.select(F.col("tk").alias("btk"), F.col("held").alias("v")), "btk")
    return both.select(F.col("aroot").alias("a"), F.col("broot").alias("b"), "u", "v").mapInArrow(similar, "a long, b long")
