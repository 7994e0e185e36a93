"""Stateful operators of streams with bounded state: a sliding request limit and an LRU cache (STM2, STM3, WN11).

Both use transformWithState: state is read and written once a user and batch, and event-time timers release what has to wait
for the watermark. The state store must be RocksDB, which keeps state on disk; with_rocksdb() sets that.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestone.operators.caching import Lru

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession) -> None:
    """Streams that start from now on keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class SlidingLimit(StatefulProcessor):
    """Requests of a user are accepted unless `most` were in the last `span` milliseconds; refused ones don't count.

    A request waits until the watermark has passed it, so that requests are judged in order of time even where they come
    out of order. State: the accepted times still in the span (at most `most`) and the requests that wait (those of the
    watermark's delay).
    """

    def __init__(self, most: int, span: int) -> None:
        self.most, self.span = most, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "times array<bigint>")
        self.waiting = handle.getListState("waiting", "ms bigint, item bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(ms), int(item)) for frame in rows for ms, item in zip(frame["ms"], frame["item"], strict=True)]
        self.waiting.appendList(new)
        # One timer for the earliest request is enough: when it fires, the next one is set.
        self.handle.registerTimer(min(ms for ms, _ in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted((int(ms), int(item)) for ms, item in self.waiting.get())
        due = [r for r in rows if r[0] <= now]
        later = rows[len(due) :]
        self.waiting.clear()
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(later[0][0])
        held = [int(t) for t in self.held.get()[0]] if self.held.exists() else []
        ok = []
        for ms, _ in due:
            held = [t for t in held if t > ms - self.span]
            ok.append(len(held) < self.most)
            if ok[-1]:
                held.append(ms)
        self.held.update((held,))
        if due:
            yield pd.DataFrame({"user": key[0], "item": [i for _, i in due], "ok": ok})

    def close(self) -> None:
        pass


def limited(events: DataFrame, most: int = 60, span: str = "60 seconds", delay: str = "0 seconds", user: str = "user_id", ts: str = "ts", item: str = "event_id") -> DataFrame:
    """user, item, ok: the verdict on each request of a stream, given once the watermark (`delay` behind the latest) has passed it.

    Rows that come later than the watermark are dropped, and count for nothing; those that the watermark never passes (the
    last ones of a stream that ends) have no verdict. Rows without a user or a time go.
    """
    spark = events.sparkSession
    with_rocksdb(spark)
    width = int(spark.sql(f"SELECT unix_millis(TIMESTAMP '1970-01-01 00:00:00 UTC' + INTERVAL '{span}')").first()[0])
    rows = events.filter(F.col(user).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, delay)
    rows = rows.select(F.col(user).cast("long").alias("user"), ts, F.unix_millis(ts).alias("ms"), F.col(item).cast("long").alias("item"))
    return rows.groupBy("user").transformWithStateInPandas(SlidingLimit(most, width), "user long, item long, ok boolean", "append", "eventTime")


class LruState(StatefulProcessor):
    """A cache for each user whose keys, in order of use, are the state: at most `size` of them."""

    def __init__(self, size: int) -> None:
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.keys = handle.getValueState("keys", "keys array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cache = Lru(self.size, list(self.keys.get()[0]) if self.keys.exists() else [])
        whole = pd.concat(list(rows)).sort_values(["ms", "item"])
        used = [cache.use(k) for k in whole["key"]]
        self.keys.update((list(cache.held),))
        yield pd.DataFrame({"user": key[0], "item": whole["item"], "hit": [h for h, _ in used], "evicted": [e for _, e in used]})

    def close(self) -> None:
        pass


def cached(requests: DataFrame, size: int = 256, user: str = "user_id", key: str = "key", ts: str = "ts", item: str = "event_id") -> DataFrame:
    """user, item, hit, evicted: what a cache of `size` keys for each user says to a stream of requests (see caching.lru()).

    Requests of a micro-batch are taken in order of time, batches as they come.
    """
    with_rocksdb(requests.sparkSession)
    rows = requests.filter(F.col(user).isNotNull()).select(F.col(user).cast("long").alias("user"), F.unix_millis(ts).alias("ms"), F.col(item).cast("long").alias("item"), F.col(key).cast("string").alias("key"))
    return rows.groupBy("user").transformWithStateInPandas(LruState(size), "user long, item long, hit boolean, evicted string", "append", "none")
