"""Counters of requests that come along with the work itself, in batch and in streams (AG52)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def counters(latency: str | Column, failed: Column) -> list[Column]:
    """requests, failures, measured (latencies that aren't null), total of latencies: what means are made of."""
    ms = F.col(latency) if isinstance(latency, str) else latency
    return [F.count(F.lit(1)).alias("requests"), F.count_if(failed).alias("failures"), F.count(ms).alias("measured"), F.coalesce(F.sum(ms), F.lit(0.0)).alias("total")]


def observed(df: DataFrame, latency: str | Column, failed: Column, name: str = "requests") -> tuple[DataFrame, Observation]:
    """df, and what its next action counts on the way; no pass over the data of its own."""
    seen = Observation(name)
    return df.observe(seen, *counters(latency, failed)), seen


def mean(counts: dict) -> float | None:
    """The mean latency of counts, None without any."""
    return counts["total"] / counts["measured"] if counts["measured"] else None


class RequestCounter(StreamingQueryListener):
    """Adds up the counters that streams observe under a name; add it to spark.streams, and remove it afterwards."""

    def __init__(self, name: str = "requests") -> None:
        self.name, self.batches, self.counts = name, 0, {"requests": 0, "failures": 0, "measured": 0, "total": 0.0}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if (row := event.progress.observedMetrics.get(self.name)) is not None and row["requests"]:
            self.batches += 1
            for k in self.counts:
                self.counts[k] += row[k]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
