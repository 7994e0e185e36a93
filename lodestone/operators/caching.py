"""A bounded LRU cache over a stored stream of requests: hits, evictions and hit rates (STM2).

The cache holds the `size` keys used last, so what it holds at some point is known from the last `size` distinct keys
before it. Requests are range-sorted; each part sums up the keys that it used last, these summaries are combined over the
parts before by doubling, and each part is then replayed from the cache that it starts with. No user, and no order, is ever in
one task as a whole, and what is carried from part to part is bounded by the size of the cache.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import cut


class Lru:
    """Keys in order of their last use, the latest last."""

    def __init__(self, size: int, keys: list[str] = ()) -> None:
        self.size, self.held = size, OrderedDict.fromkeys(keys)

    def use(self, key: str | None) -> tuple[bool, str | None]:
        """(hit, the key that went to make room, if any)."""
        if key in self.held:
            self.held.move_to_end(key)
            return True, None
        self.held[key] = None
        return False, self.held.popitem(last=False)[0] if len(self.held) > self.size else None


def _last_keys(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Only a part's first and last users can have requests in other parts.
        part, first, user, cache, out = None, None, None, None, []
        for batch in batches:
            for p, u, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cache is None or u != user:
                    if cache is not None and (user == first or not out):
                        out.append((part, user, list(cache.held)[::-1]))
                    first = u if cache is None else first
                    part, user, cache = p, u, Lru(size)
                cache.use(k)
        if cache is not None:
            out.append((part, user, list(cache.held)[::-1]))
        yield pa.RecordBatch.from_pylist([{"part": p, "user": u, "keys": k} for p, u, k in out], pa.schema([("part", pa.int64()), ("user", pa.string()), ("keys", pa.list_(pa.string()))]))

    return run


def lru(requests: DataFrame, key: str, order: list[str], user: str | None = None, size: int = 256) -> DataFrame:
    """requests with hit and evicted (a key, or null): what a cache of `size` keys says, one for each user or one for all.

    A request hits if fewer than `size` other keys were used since its own was used last; a miss puts the key in, and the one
    whose last use is longest ago goes if there is no room. `order` must tell all requests of a user apart. A null key is a key
    like any other, and a null user a user. Empty tables give no rows.
    """
    names = requests.columns
    who = F.lit("") if user is None else F.coalesce(F.concat(F.lit("="), F.col(user).cast("string")), F.lit(""))
    rows = requests.withColumns({"_user": who, "_key": F.col(key).cast("string")})
    ranged = rows.repartitionByRange("_user", *order).sortWithinPartitions("_user", *order)
    parts = cut(ranged.withColumn("_part", F.spark_partition_id().cast("long")))
    last = cut(parts.select("_part", "_user", "_key").mapInArrow(_last_keys(size), "part long, user string, keys array<string>"))
    span = last.agg(F.max("part") - F.min("part")).first()[0] or 0
    step = 1
    while step <= span:  # after each round a summary covers twice as many parts
        before = last.select((F.col("part") + step).alias("part"), "user", F.col("keys").alias("_before"))
        both = F.slice(F.array_distinct(F.concat("keys", F.coalesce("_before", F.array().cast("array<string>")))), 1, size)
        last = cut(last.join(before, ["part", "user"], "left").select("part", "user", both.alias("keys")))
        step *= 2
    start = last.select((F.col("part") + 1).alias("_part"), F.col("user").alias("_user"), "keys")

    def replay(left: pa.Table, right: pa.Table) -> pa.Table:
        caches = {r["_user"]: r["keys"] for r in right.to_pylist()}
        left = left.sort_by([(c, "ascending") for c in ("_user", *(f"_o{i}" for i in range(len(order))))])
        user, cache, hit, evicted = None, None, [], []
        for u, k in zip(left.column("_user").to_pylist(), left.column("_key").to_pylist(), strict=True):
            if cache is None or u != user:
                user, cache = u, Lru(size, (caches.get(u) or [])[::-1])
            h, e = cache.use(k)
            hit.append(h)
            evicted.append(e)
        kept = left.select([f"_c{i}" for i in range(len(names))])
        return kept.append_column("hit", pa.array(hit, pa.bool_())).append_column("evicted", pa.array(evicted, pa.string()))

    plain = parts.select("_part", "_user", "_key", *[F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)])
    kinds = ", ".join(f"_c{i} {kind}" for i, (_, kind) in enumerate(requests.dtypes))
    out = plain.groupBy("_part").cogroup(start.groupBy("_part")).applyInArrow(replay, f"{kinds}, hit boolean, evicted string")
    return out.toDF(*names, "hit", "evicted")


def hit_rates(replayed: DataFrame, user: str | None = None) -> DataFrame:
    """[user,] requests, hits, evictions, hit_rate of lru()."""
    keys = [user] if user else []
    n, h = F.count(F.lit(1)), F.count_if("hit")
    return replayed.groupBy(*keys).agg(n.alias("requests"), h.alias("hits"), F.count("evicted").alias("evictions"), (h / n).alias("hit_rate"))
