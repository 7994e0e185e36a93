"""Queries of caches and limits, and of streams whose results are final: append mode, late rows, joins with stored tables."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import caching, graph
from lodestone.plans.graphs import _NODES, edges, nodes, raw_edges
from lodestone.plans.registry import query, table
from lodestone.plans.texts import _plain, _stream
from lodestone.session import passing_path
from lodestone.sources import graphml
from lodestone.sources.versions import Unhealthy, Versions
from lodestone.streaming import stateful, windows
from lodestone.streaming.counters import RequestCounter, counters, mean

# A request hits if fewer other keys than the cache holds were used since its own was used last.
_LRU = """p AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY o1, o2) AS i FROM r),
q AS (SELECT *, lag(i) OVER (PARTITION BY u, k ORDER BY i) AS was FROM p),
d AS (SELECT q.u, q.i, count(DISTINCT x.k) AS n FROM q JOIN p x ON x.u = q.u AND x.i > q.was AND x.i < q.i GROUP BY q.u, q.i),
h AS (SELECT q.*, was IS NOT NULL AND coalesce(d.n, 0) < {size} AS hit FROM q LEFT JOIN d USING (u, i)),
z AS (SELECT *, count(*) FILTER (NOT hit) OVER (PARTITION BY u ORDER BY i) > {size} AND NOT hit AS evicts FROM h)
"""
_FIRST_WORD = r"regexp_extract(text, '^\S+')"


@query(rf"""WITH r AS (SELECT 0 AS u, conv_id AS o1, turn AS o2, sha256(regexp_replace(lower(trim({_FIRST_WORD})), '\s+', ' ', 'g'))[1:16] AS k FROM conversations WHERE role = 'user'),
{_LRU.format(size=256)} SELECT o1 AS conv_id, o2 AS turn, hit, evicts FROM z""")
def router_cache_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM2: the router's cache of 256 questions over all user turns, which are taken as questions by their first word."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", T.cache_key(F.regexp_extract("text", r"^\S+", 0)).alias("k"))
    return caching.lru(turns, "k", ["conv_id", "turn"]).select("conv_id", "turn", "hit", F.col("evicted").isNotNull().alias("evicts"))


_KEYS = "event_type || CAST(CAST(floor(value / 8) AS BIGINT) AS VARCHAR)"


def _requests(events: DataFrame) -> DataFrame:
    return events.select("user_id", "ts", "event_id", F.concat("event_type", F.floor(F.col("value") / 8).cast("string")).alias("key"))


@query(f"""WITH r AS (SELECT user_id AS u, ts AS o1, event_id AS o2, {_KEYS} AS k FROM events), {_LRU.format(size=16)}
SELECT u AS user_id, count(*) AS requests, count(*) FILTER (hit) AS hits, count(*) FILTER (evicts) AS evictions, round(count(*) FILTER (hit) / count(*), 9) AS hit_rate FROM z GROUP BY u""")
def user_cache_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM2: a cache of 16 answers for each user, and its hit rate."""
    replayed = caching.lru(_requests(table(spark, sf_dir, "events")), "key", ["ts", "event_id"], "user_id", 16)
    return caching.hit_rates(replayed, "user_id").withColumn("hit_rate", F.round("hit_rate", 9))


@query(f"""WITH r AS (SELECT user_id AS u, ts AS o1, event_id AS o2, {_KEYS} AS k FROM events), {_LRU.format(size=16)}
SELECT u AS user_id, o2 AS event_id, hit, evicts FROM z""")
def stream_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM2 as a stream: the same caches as state."""
    out = windows.drain(stateful.cached(_requests(_stream(spark, sf_dir)), 16), "stream_cache")
    return out.select(F.col("user").alias("user_id"), F.col("item").alias("event_id"), "hit", F.col("evicted").isNotNull().alias("evicts"))


@query("""WITH e AS (SELECT user_id, list([epoch_ms(ts) * 1000000 + event_id] ORDER BY ts, event_id) AS xs FROM events GROUP BY user_id),
a AS (SELECT user_id, unnest(list_reduce(xs, lambda acc, x: CASE WHEN len(list_filter(acc, lambda t: t // 1000000 > x[1] // 1000000 - 21600000)) < 3 THEN list_concat(acc, x) ELSE acc END)) AS t FROM e),
m AS (SELECT max(epoch_ms(ts)) AS last FROM events)
SELECT e.user_id, e.event_id, a.t IS NOT NULL AS ok FROM events e LEFT JOIN a ON a.user_id = e.user_id AND a.t = epoch_ms(e.ts) * 1000000 + e.event_id, m WHERE epoch_ms(e.ts) <= last - 600000""")
def rate_limit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM3, WN11: at most three accepted requests of a user in six hours; a verdict comes when the watermark, ten minutes late, has passed."""
    e = _stream(spark, sf_dir).select("user_id", "ts", "event_id")
    return windows.drain(stateful.limited(e, 3, "6 hours", "10 minutes"), "rate_limit_stream").select(F.col("user").alias("user_id"), F.col("item").alias("event_id"), "ok")


@query("""WITH w AS (SELECT time_bucket(INTERVAL 1 day, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL)
SELECT * FROM w WHERE start + INTERVAL 1 day <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 hour FROM events)""")
def stream_final_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: tumbling windows in append mode, each given once, when the watermark has passed its end; then its state goes."""
    out = windows.drain(windows.windowed(_stream(spark, sf_dir), "1 day", late="1 hour"), "stream_final_windows")
    return _plain(out.withColumn("total", F.round("total", 6)), "start")


@query("""WITH j AS (SELECT e.ts, c.c_mktsegment AS segment, e.value FROM events e JOIN customer c ON c.c_custkey = e.user_id),
w AS (SELECT time_bucket(INTERVAL 12 hours, ts) AS start, segment, count(*) AS n, round(sum(value), 6) AS total FROM j GROUP BY ALL)
SELECT * FROM w WHERE start + INTERVAL 12 hours <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 30 minutes FROM events)""")
def stream_joined_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: a stream joined with a stored table, then windows that are final. The watermark is that of all events."""
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    joined = _stream(spark, sf_dir).withWatermark("ts", "30 minutes").join(people, "user_id")
    out = windows.drain(windows.final(joined, "12 hours", "segment"), "stream_joined_windows")
    return _plain(out.withColumn("total", F.round("total", 6)), "start")


# Events come in four deliveries, of which each but the first also holds rows of the past: every 7th event is one late.
_DELIVERIES = "d AS (SELECT *, least(3, CAST(event_id * 4 // (SELECT max(event_id) + 1 FROM events) AS INTEGER) + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) AS k FROM events)"


@query(f"""WITH {_DELIVERIES}, s AS (SELECT k, max(epoch_ms(ts)) AS top FROM d GROUP BY k),
m AS (SELECT k, max(top) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 86400000 AS mark FROM s)
SELECT CAST(d.k AS BIGINT) AS batch, event_type, count(*) AS n, count(*) FILTER (epoch_ms(ts) < mark) AS late FROM d JOIN m USING (k) GROUP BY ALL""")
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: how many rows of each micro-batch are later than a day behind what came before; late rows are kept apart."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    top = events.agg(F.max("event_id")).first()[0]
    k = F.least(F.lit(3), F.floor(F.col("event_id") * 4 / (top + 1)).cast("int") + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0))
    deliveries = windows.delivered([events.filter(k == i) for i in range(4)], "deliveries")
    found = windows.split_late(deliveries, "late_rows", "1 day")
    return found.groupBy("batch", "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("late").alias("late"))


# Edges that customers give come in four deliveries; the sum over all is what a rebuild gives.
_FOUR = 4


@query(f"WITH {_NODES} SELECT head, relation, tail, CAST(weight AS DOUBLE) AS weight, chunk_ids FROM edges1")
def graph_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM5: edges merged into a bucketed table batch by batch, each batch given twice; the result equals a rebuild."""
    keys = ["head", "relation", "tail"]
    sound = raw_edges(spark, sf_dir).filter("head <> '' AND tail <> ''")
    k = F.pmod(F.xxhash64("head", "chunk_ids"), F.lit(_FOUR))
    log = Versions(spark, passing_path(spark, "graph"))
    log.write(sound.limit(0), buckets=8, keys=keys)

    def merge(df: DataFrame, batch: int) -> None:
        for _ in range(2):
            log.merge(df, lambda old, new: graph.merge_edges(old.unionByName(new)), batch)

    deliveries = windows.delivered([sound.filter(k == i) for i in range(_FOUR)], "edges")
    windows.merge_each(deliveries, merge, "graph")
    return log.read()


@query("SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS revision FROM documents WHERE doc_id % 11 <> 0 OR doc_id % 5 = 0")
def ingest_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM6: a delivery of documents, then one of changed ones; only what is new or differs by digest is written, to the buckets it touches."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    first = d.filter("doc_id % 11 <> 0").select("doc_id", F.sha2("text", 256).alias("h"), F.lit(0).alias("revision"))
    second = d.filter("doc_id % 5 = 0").select("doc_id", F.sha2(F.concat("text", F.lit("!")), 256).alias("h"), F.lit(1).alias("revision")).unionAll(first.filter("doc_id % 5 = 1"))
    log = Versions(spark, passing_path(spark, "ingest"))
    log.write(first.limit(0), buckets=8, keys=["doc_id"])

    def changed(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.unionByName(new).groupBy("doc_id").agg(F.max_by("h", "revision").alias("h"), F.max("revision").alias("revision"))

    windows.merge_each(windows.delivered([first, second], "documents"), lambda df, batch: log.merge(df, changed, batch), "ingest")
    return log.read()


@query("SELECT o_orderstatus AS status, count(*) AS n, CAST(2 AS BIGINT) AS version FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_orderstatus")
def blue_green_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK11, SNK7: an empty table, then half of the orders; a version that fails its check isn't switched to."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), "o_orderkey")
    log = Versions(spark, passing_path(spark, "orders"))
    log.write(o.limit(0))
    healthy = lambda df: not df.isEmpty() and df.filter("status IS NULL").isEmpty()
    version = log.write(o.filter("o_orderkey % 2 = 0"), healthy)
    try:
        log.write(o.limit(0), healthy)
    except Unhealthy:
        pass
    return log.read().groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("version", F.lit(version).cast("long"))


@query(f"WITH {_NODES} SELECT head, relation, tail, CAST(weight AS DOUBLE) AS weight, (SELECT text FROM nodes1 WHERE node_id = head) AS head_text FROM edges1")
def graphml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC15, SNK6: the graph written as GraphML and read back, with typed attributes and parallel edges."""
    n, e = nodes(spark, sf_dir), edges(spark, sf_dir)
    path = passing_path(spark, "graphml")
    graphml.write_graph(n.withColumnRenamed("node_id", "id"), e.withColumnsRenamed({"head": "source", "tail": "target"}), path)
    found, links = graphml.read_graph(spark, path)
    named = found.select(F.col("id").alias("source"), F.col("text").alias("head_text"))
    return links.join(named, "source").select(F.col("source").alias("head"), "relation", F.col("target").alias("tail"), "weight", "head_text")


@query("SELECT count(*) AS requests, count(*) FILTER (event_type = 'error') AS failures, round(avg(CASE WHEN event_type <> 'view' THEN value END), 6) AS mean, count(*) AS written FROM events")
def request_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG52: counters that a stream observes while it is written, added up by a listener."""
    seen = RequestCounter()
    spark.streams.addListener(seen)
    try:
        latency = F.when(F.col("event_type") != "view", F.col("value"))
        told = _stream(spark, sf_dir).observe(seen.name, *counters(latency, F.col("event_type") == "error"))
        written = windows.drain(told.select("event_id"), "requests")
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        for _ in range(100):  # Python listeners are told a moment later
            if seen.batches:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(seen)
    c = seen.counts
    row = spark.range(1).select(F.lit(c["requests"]).cast("long").alias("requests"), F.lit(c["failures"]).cast("long").alias("failures"), F.round(F.lit(mean(c)).cast("double"), 6).alias("mean"))
    return row.join(F.broadcast(written.agg(F.count(F.lit(1)).alias("written"))), F.lit(True))  # one row each
