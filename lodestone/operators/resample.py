"""Bootstrap intervals in one pass: each row's weights in all resamples come from a hash of its id (AG35)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How often a row is drawn: weight k or more if its hash reaches this share (a Poisson distribution of mean 1).
SHARES = (0.367879441, 0.735758882, 0.919698603, 0.981011843, 0.996340153)
MASK = 0xFFFFFFFF
STEP = 256


def draws(ids: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """Rows x resamples: 32-bit numbers that any engine with 64-bit integers can compute (see draws_sql())."""
    mask = np.uint64(MASK)
    x = (ids.astype(np.int64).view(np.uint64)[:, None] & mask) * np.uint64(1103515245) + np.arange(resamples, dtype=np.uint64) * np.uint64(1640531513) + np.uint64(seed)
    x &= mask
    for _ in range(2):
        x = (x ^ (x >> np.uint64(16))) * np.uint64(73244475) & mask
    return x ^ (x >> np.uint64(16))


def draws_sql(id_: str, r: str, seed: int) -> str:
    """The same number as an SQL expression."""
    x = f"(({id_} & {MASK}) * 1103515245 + {r} * 1640531513 + {seed}) & {MASK}"
    for _ in range(2):
        x = f"(xor({x}, ({x}) >> 16) * 73244475) & {MASK}"
    return f"xor({x}, ({x}) >> 16)"


def _sums(resamples: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, total = np.zeros(resamples, np.int64), np.zeros(resamples)
        for batch in batches:
            ids, values = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for i in range(0, len(ids), STEP):
                x = draws(ids[i : i + STEP], resamples, seed)
                w = sum((x > np.uint64(int(s * (MASK + 1)))).astype(np.int64) for s in SHARES)
                weight += w.sum(0)
                total += (w * values[i : i + STEP, None]).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), pa.array(weight), pa.array(total)], names=["r", "w", "t"])

    return run


def bootstrap(df: DataFrame, value: str, row_id: str, resamples: int = 2000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """One row: n, mean, low, high, resamples; the interval of the mean of `value`, null for under two rows.

    Each task sums up all resamples of its rows at once, so a task sends one row a resample, whatever its input. Null values
    go; rows of one id are drawn together.
    """
    rows = df.filter(F.col(value).isNotNull() & F.col(row_id).isNotNull()).select(F.col(row_id).cast("long").alias("id"), F.col(value).cast("double").alias("v"))
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))
    means = rows.mapInArrow(_sums(resamples, seed), "r long, w long, t double").groupBy("r").agg((F.sum("t") / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    ends = means.agg(F.percentile("m", (1 - level) / 2).alias("low"), F.percentile("m", (1 + level) / 2).alias("high"))
    enough = F.col("n") >= 2
    both = whole.join(F.broadcast(ends), F.lit(True))  # one row each
    return both.select("n", "mean", F.when(enough, F.col("low")).alias("low"), F.when(enough, F.col("high")).alias("high"), F.lit(resamples).cast("long").alias("resamples"))
