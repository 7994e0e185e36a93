"""Structured Streaming forms: windows with watermarks, deduplication, rate limits, graph merges (STM1, STM3, STM5, STM6, STM8).

The window operators are extensions: the reference has no event-time streams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.session import passing_path, remove_path, shared_path


def read(spark: SparkSession, folder: str, table: str, schema) -> DataFrame:
    """A stream of the Parquet files of one table in a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What a stream gives for all that is there now, as a table in Parquet: rows appended, or, in complete mode, each
    batch's whole result in place of the one before. Executors write it; nothing goes to the driver.

    The stream's state goes when it has ended, and the table when Python ends.
    """
    spark = stream.sparkSession
    state, path = shared_path(spark, f"{name}-state"), passing_path(spark, name)
    to = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        to.format("parquet").option("path", path).start().awaitTermination()
    else:
        spark.createDataFrame([], stream.schema).write.parquet(path)
        to.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start().awaitTermination()
    remove_path(spark, state)
    return spark.read.schema(stream.schema).parquet(path)


def delivered(parts: list[DataFrame], name: str) -> Iterator[DataFrame]:
    """A stream over a folder to which the parts are added one by one: each time it is given, one more part is there.

    Run it to its end each time, with one checkpoint for all, and each part is a micro-batch of its own.
    """
    path = passing_path(parts[0].sparkSession, name)
    for part in parts:
        part.write.mode("append").parquet(path)
        yield part.sparkSession.readStream.schema(part.schema).parquet(path)


def split_late(deliveries: Iterator[DataFrame], name: str, late: str, ts: str = "ts") -> DataFrame:
    """All rows of the streams with `batch` and `late`: whether a row is further behind the latest row of the batches before
    than `late`. A watermark drops such rows; here they are told apart and kept.

    A batch writes its rows and its latest time under its own number, so a batch that is run again replaces itself.
    """
    marks = state = out = None
    for stream in deliveries:
        spark = stream.sparkSession
        if out is None:
            out, marks, state = passing_path(spark, name), passing_path(spark, f"{name}-marks"), shared_path(spark, f"{name}-state")

        def run(df: DataFrame, batch: int, out: str = out, marks: str = marks) -> None:
            own = df.sparkSession
            before = None
            if batch > 0:
                before = own.read.schema("top long, batch long").parquet(marks).filter(F.col("batch") < batch).agg(F.max("top")).first()[0]
            at = F.unix_millis(ts)
            behind = F.lit(False) if before is None else at < F.lit(before) - F.unix_millis(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL '{late}'"))
            df.withColumn("late", F.coalesce(behind, F.lit(False))).write.mode("overwrite").parquet(f"{out}/batch={batch}")
            df.agg(F.max(at).alias("top")).write.mode("overwrite").parquet(f"{marks}/batch={batch}")

        stream.writeStream.foreachBatch(run).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    remove_path(spark, state)
    return spark.read.parquet(out).withColumn("batch", F.col("batch").cast("long"))


def final(events: DataFrame, width: str, key: str, ts: str = "ts", value: str = "value") -> DataFrame:
    """start, key, n, total of tumbling windows, for a stream that has a watermark already."""
    out = events.groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), key, "n", "total")


def windowed(events: DataFrame, width: str, step: str | None = None, late: str = "1 hour", ts: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """start, key, n, total for tumbling windows, or sliding ones with a step; later rows than the watermark are dropped."""
    w = F.window(ts, width, step) if step else F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(w, key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour", ts: str = "ts", key: str = "user_id") -> DataFrame:
    """start, end_, key, n: sessions that a gap ends."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end_"), key, "n")


def first_in(events: DataFrame, key: str, delay: str = "15 minutes", ts: str = "ts") -> DataFrame:
    """Misses of a cache that keeps an answer for `delay`: repeated keys within it are dropped (STM1)."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def accepted(times: list[float], earlier: list[float], most: int, span: float) -> tuple[list[bool], list[float]]:
    """Which requests pass a limit of `most` accepted ones in the last `span` seconds, and the accepted times still in it."""
    held, out = list(earlier), []
    for t in times:
        held = [x for x in held if x > t - span]
        out.append(len(held) < most)
        if out[-1]:
            held.append(t)
    return out, held


def rate_limited(events: DataFrame, most: int = 60, span: float = 60.0, key: str = "user_id", ts: str = "ts", item: str = "event_id") -> DataFrame:
    """key, item, ok: a sliding limit per key that refused requests don't count towards (STM3, WN11); for streams, with
    the accepted times as state."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        whole = pd.concat(list(frames)).sort_values([ts, item])
        ok, held = accepted([t.timestamp() for t in whole[ts]], held, most, span)
        state.update((held,))
        yield pd.DataFrame({key: whole[key], item: whole[item], "ok": ok})

    return events.groupBy(key).applyInPandasWithState(run, f"{key} long, {item} long, ok boolean", "held array<double>", "append", GroupStateTimeout.NoTimeout)


def merge_each(deliveries: Iterator[DataFrame], merge: Callable[[DataFrame, int], None], name: str) -> None:
    """Runs merge(rows, batch) on each micro-batch of the streams, one after the other (STM5, STM6). A batch may come again
    after a failure, with the same number: merge must not count it twice."""
    state = None
    for stream in deliveries:
        state = state or shared_path(stream.sparkSession, f"{name}-state")
        stream.writeStream.foreachBatch(merge).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    if state is not None:
        remove_path(stream.sparkSession, state)
