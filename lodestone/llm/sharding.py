"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups are reduced to size classes (at most 1,024 for each doubling of the size, so at most about 60,000 rows however
many groups there are); the driver packs the classes, largest first, each run of equal sizes into the tightest bin that
still has room, found in a balanced tree; executors then look up each group's bin by its size class and rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import buckets_for, drop_staged, numbered, pick, staged

EXACT = 4096
CHUNK = 4096


class Gaps:
    """A treap of (room, bin): insert, and removal of the smallest room that is at least a size, in O(log n)."""

    def __init__(self) -> None:
        self.root: list | None = None
        self.state = 0x9E3779B9

    def _priority(self) -> int:
        self.state = (self.state * 6364136223846793005 + 1442695040888963407) & 0xFFFFFFFFFFFFFFFF
        return self.state >> 20

    def _split(self, node: list | None, key: tuple) -> tuple[list | None, list | None]:
        """Nodes below key, nodes from key on. A node is [key, priority, left, right]."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = self._split(node[3], key)
            return node, right
        left, node[2] = self._split(node[2], key)
        return left, node

    def _merge(self, a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def add(self, room: int, which: int) -> None:
        left, right = self._split(self.root, (room, which))
        self.root = self._merge(self._merge(left, [(room, which), self._priority(), None, None]), right)

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the tightest (room, bin) with room >= size."""
        left, right = self._split(self.root, (size, -1))
        if right is None:
            self.root = left
            return None
        node = right
        while node[2] is not None:
            node = node[2]
        _, rest = self._split(right, (node[0][0], node[0][1] + 1))
        self.root = self._merge(left, rest)
        return node[0]


Segment = tuple[int, int, int, int]


def best_fit(classes: list[tuple[int, int]], capacity: int, bins: int | None = None, first: int = 0) -> tuple[list[Segment], int] | None:
    """([(size, first rank, one past last rank, bin)], bins used) for (size, count) in falling order of size.

    Equal sizes go into the same tightest bin while they fit, which is what item by item best fit does with them. None
    if more than `bins` bins would be needed. An item over the capacity gets a bin of its own.
    """
    gaps, out, used = Gaps(), [], 0
    for size, count in classes:
        done = 0
        while done < count:
            got = gaps.take(size)
            if got is None:
                if bins is not None and used >= bins:
                    return None
                got, used = (max(capacity, size), first + used), used + 1
            n = min(count - done, got[0] // size)
            out.append((size, done, done + n, got[1]))
            done += n
            if got[0] > n * size:
                gaps.add(got[0] - n * size, got[1])
    return out, used


def balance(classes: list[tuple[int, int]], bins: int) -> list[Segment]:
    """best_fit() into at most `bins` bins with the least capacity found: sizes come out near equal.

    Items larger than an even share of what is left get bins of their own first.
    """
    left, out, alone = dict(classes), [], 0
    total = sum(s * n for s, n in classes)
    for size in sorted(left, reverse=True):
        while left[size] and bins - alone > 1 and size * (bins - alone) > total:
            taken = dict(classes)[size] - left[size]
            out.append((size, taken, taken + 1, alone))
            left[size] -= 1
            total -= size
            alone += 1
    shift = {s: n - left[s] for s, n in classes}
    rest = [(s, left[s]) for s, _ in classes if left[s]]
    if not rest:
        return out
    low = max(-(-total // (bins - alone)), rest[0][0])
    step, high, found = max(1, total // 1_000_000), low, None
    while (found := best_fit(rest, high, bins - alone, alone)) is None:
        high, step = high + step, step * 2
    low = max(low, high - step // 2)
    while high - low > max(1, total // 1_000_000):
        mid = (low + high) // 2
        if (got := best_fit(rest, mid, bins - alone, alone)) is None:
            low = mid
        else:
            high, found = mid, got
    return out + [(s, a + shift[s], b + shift[s], k) for s, a, b, k in found[0]]


def _class(size):
    """The size, above EXACT rounded up to one of 1,024 steps for each doubling."""
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(size)) - 10, F.lit(0))).cast("long")
    return F.when(size <= EXACT, size).otherwise(F.ceil(size / step) * step).cast("long")


def shard(
    docs: DataFrame, shards: int | None = 8, capacity: int | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per row of docs.

    A group is all rows of one text and is never split; its size is the sum of its rows' sizes (UTF-8 bytes plus 1; a
    null text has none, and null texts are a group). With `shards`, groups are packed into that many shards of near
    equal bytes: the capacity is the least for which best-fit-decreasing needs no more bins, and a group over an even
    share has a shard of its own. With `capacity` (bytes), as few shards of that capacity as best-fit-decreasing finds
    are used; a group over the capacity gets a shard of its own. Slots number a shard's rows from 0 without gaps.

    Law: `bytes`; so grown_shard is null. Above 4,096 bytes a group's size is rounded up by at most a thousandth when
    packed, so a capacity is never exceeded. Rows that repeat are rows of their own in the same shard. A null doc_id is
    kept. Empty tables give no rows; further columns are ignored. Texts are hashed where they are read and never moved.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("either shards or capacity")
    spark = docs.sparkSession
    rows = staged(
        pick(docs, doc_id=doc_id, text=text).select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.xxhash64("text").alias("h1"),
            F.xxhash64(F.lit(7), "text").alias("h2"),
        ),
        "rows",
    )
    groups = staged(
        rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).select("h1", "h2", _class(F.col("bytes")).alias("class"), "n"), "groups"
    )
    counted = groups.groupBy("class").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows")).collect()
    classes = sorted(((r["class"], r["groups"]) for r in counted), reverse=True)
    n_rows = sum(r["rows"] for r in counted)
    segments = balance(classes, shards) if shards is not None else best_fit(classes, capacity)[0]
    plan = [(size, c, a, b, k) for size, a, b, k in segments for c in range(a // CHUNK, (b - 1) // CHUNK + 1)]
    kinds = T.StructType([T.StructField(n, T.LongType()) for n in ("class", "chunk", "low", "high", "shard")])
    where = spark.createDataFrame(plan, kinds)
    ranked = numbered(groups, "class", F.col("h2"), [F.col("h1"), F.col("h2")], "rank", buckets_for(n_rows))
    placed = staged(
        ranked.withColumn("chunk", (F.col("rank") / CHUNK).cast("long"))
        .join(where, ["class", "chunk"])
        .filter("rank >= low AND rank < high")
        .select("h1", "h2", F.col("shard").cast("int")),
        "placed",
    )
    dealt = staged(rows.join(placed, ["h1", "h2"]).select("doc_id", "size", "text_crc32", "shard"), "dealt")
    slots = numbered(dealt, "shard", F.struct("doc_id", "text_crc32"), [F.col("doc_id"), F.col("text_crc32")], "slot", max(512, buckets_for(n_rows)))
    drop_staged(groups)
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
