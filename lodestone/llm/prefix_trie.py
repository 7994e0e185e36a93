"""The prefix trie of conversations by prefix-doubling naming.

Equal sequences of turns get equal names. Turns are named first (dense numbers); then each pair of neighbouring, aligned
blocks of 2^k turns gets a name by its two names, so all aligned blocks of all power-of-two lengths are named in as many
join rounds as the longest conversation has bits. A prefix of d turns is the sequence of blocks that the binary digits of d
cut it into, and its key is their names: at most log d numbers, however long the texts. Equal keys are one node.

Sums over subtrees follow parent pointers that jump twice as far each round, with what lies below each node in reach.
No conversation, turn or node is ever gathered in one task: turns are numbered over a range sort, and names, nodes and sums
come from aggregations that combine before the exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import drop_staged, pick, staged

#: Row numbers of a partition in monotonically_increasing_id().
ROWS = 1 << 33
STEP = 4096
EMPTY = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, pos (from 0), name (SHA-256 of role and text), chars: the turns of each conversation in order; staged.

    Order: turn (null first), then role and text. Null roles and texts are empty ones; rows without a conv_id go. Rows are
    numbered over a range sort, so that one conversation may hold any share of them.
    """
    rows = pick(conversations, conv_id=conv_id, turn=turn, role=role, text=text).filter(F.col("conv_id").isNotNull())
    role_, text_ = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # The length of the role keeps ("a", "bc") and ("ab", "c") apart.
    name = F.sha2(F.concat_ws(":", F.length(role_), role_, text_).cast("binary"), 256)
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(name).alias("name"), F.length(text_).cast("long").alias("chars"))
    order = ["conv_id", "turn", "name"]
    ranged = plain.repartitionByRange(*order).sortWithinPartitions(*order)
    found = staged(ranged.select("conv_id", "name", "chars", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "turns")
    return _numbered(found)


def _numbered(found: DataFrame) -> DataFrame:
    """pos: each row's number within its conversation, from its row number and what earlier partitions hold of it."""
    spans = found.groupBy("conv_id", "part").agg(F.min("row").alias("least"), F.count(F.lit(1)).alias("held"))
    # A conversation has as many spans as partitions at most.
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = spans.select("conv_id", "part", "least", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    joined = found.join(start, ["conv_id", "part"])
    out = staged(joined.select("conv_id", (F.col("row") - F.col("least") + F.col("start")).alias("pos"), "name", "chars"), "numbered")
    drop_staged(found)
    return out


def borrowed(conv_id: Column, of: int) -> Column:
    """How many turns a conversation takes from another: the checksum of its decimal id modulo `of`."""
    return F.crc32(conv_id.cast("string").cast("binary")) % of


def rebuilt(seq: DataFrame, group: int = 100, of: int = 6) -> tuple[DataFrame, DataFrame]:
    """(ids, sequences) with a common beginning borrowed: the first h turns of conversation c - c % group, then c's own after its
    first h, where h is borrowed(). ids: conv_id, n (turns). Staged.

    A base that is absent lends nothing, a shorter one all that it has.
    """
    ids = staged(seq.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), borrowed(F.col("conv_id"), of).alias("h")), "ids")
    lent = seq.filter((F.col("pos") < of) & (F.col("conv_id") % group == 0)).select(F.col("conv_id").alias("base"), F.col("pos"), "name", "chars")
    taken = ids.filter("h > 0").join(lent, "base").filter("pos < h").select("conv_id", "pos", "name", "chars")
    sizes = ids.select(F.col("conv_id").alias("base"), F.col("own").alias("has")).filter(F.col("base") % group == 0)
    known = staged(ids.join(sizes, "base", "left").select("conv_id", "h", "own", F.least("h", F.coalesce("has", F.lit(0))).alias("k")), "known")
    # Conversations whose base lends all of h keep their places; only the others' turns move, by a small table of differences.
    shift = known.filter("k < h").select("conv_id", (F.col("k") - F.col("h")).alias("by"))
    kept = seq.filter(F.col("pos") >= borrowed(F.col("conv_id"), of)).join(shift, "conv_id", "left")
    kept = kept.select("conv_id", (F.col("pos") + F.coalesce("by", F.lit(0))).alias("pos"), "name", "chars")
    whole = staged(taken.select("conv_id", F.col("pos").cast("long").alias("pos"), "name", "chars").unionAll(kept), "sequences")
    drop_staged(ids, seq)
    return known.select("conv_id", (F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), whole


def _dense(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Each distinct combination of columns with a number from 0, gapless; staged.

    Partitions number their rows and start where those before them end; the table of starts has a row for each partition.
    """
    marked = staged(df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).select(*columns, F.monotonically_increasing_id().alias("_row")), "distinct")
    part = F.floor(F.col("_row") / ROWS)
    held = {r["p"]: r["n"] for r in marked.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, upto = [], 0
    for p in sorted(held):
        starts.append((p, upto))
        upto += held[p]
    table = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    return marked.join(F.broadcast(table), part == F.col("_part")).select(*columns, (F.col("_start") + F.col("_row") % ROWS).alias(name))


def blocks(seq: DataFrame) -> list[DataFrame]:
    """For each k: conv_id, i, name of the aligned block of turns i * 2^k .. (i + 1) * 2^k - 1; staged. Equal blocks have equal names."""
    names = _dense(seq, ["name"], "id").withColumnRenamed("name", "_name")
    level = staged(seq.join(names, F.col("name") == F.col("_name")).select("conv_id", F.col("pos").alias("i"), F.col("id").alias("name")), "blocks")
    out = []
    while True:
        out.append(level)
        half = F.shiftright("i", 1)
        left, right = F.max(F.when(F.col("i") % 2 == 0, F.col("name"))), F.max(F.when(F.col("i") % 2 == 1, F.col("name")))
        pairs = staged(level.groupBy("conv_id", half.alias("i")).agg(left.alias("a"), right.alias("b")).filter("a IS NOT NULL AND b IS NOT NULL"), "pairs")
        if pairs.isEmpty():
            drop_staged(pairs)
            return out
        names = _dense(pairs, ["a", "b"], "name").withColumnsRenamed({"a": "_a", "b": "_b"})
        level = staged(pairs.join(names, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))).select("conv_id", "i", "name"), "blocks")
        drop_staged(pairs)


def prefixes(levels: list[DataFrame]) -> DataFrame:
    """conv_id, depth, key: the names of the blocks that the binary digits of each depth cut a prefix into, longest first."""
    rows = None
    for k, level in enumerate(levels):
        # The block of digit k in d starts where the higher digits end, so i is even, and d is one of 2^k numbers from (i + 1) * 2^k.
        first = F.shiftleft(F.col("i") + 1, k)
        step = min(1 << k, STEP)  # in two steps, as one array of all might not fit in memory
        part = level.filter("i % 2 = 0").select("conv_id", F.explode(F.sequence(first, first + (1 << k) - 1, F.lit(step).cast("long"))).alias("depth"), F.lit(-k).alias("k"), "name")
        part = part.withColumn("depth", F.explode(F.sequence(F.col("depth"), F.col("depth") + step - 1)))
        rows = part if rows is None else rows.unionAll(part)
    found = rows.groupBy("conv_id", "depth").agg(F.sort_array(F.collect_list(F.struct("k", "name"))).alias("parts"), F.count(F.lit(1)).alias("n"))
    # A depth beyond the conversation's end lacks a block.
    whole = found.filter(F.col("n") == F.bit_count("depth"))
    return whole.select("conv_id", "depth", F.transform("parts", lambda p: p["name"]).alias("key"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv_id, depth, member) as pieces of comma-joined members, each of one node and at most about a megabyte."""
    at, first, held, size = None, None, [], 0
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("piece", pa.string())])

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*at, first, ",".join(held)), schema, strict=True)], schema=schema)

    for batch in batches:
        for conv, depth, member in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != (conv, depth) or size > 1 << 20:
                if at is not None:
                    yield out()
                at, first, held, size = (conv, depth), member, [], 0
            held.append(str(member))
            size += len(held[-1]) + 1
    if at is not None:
        yield out()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which come in order; one piece is held at a time."""
    at, state, found = None, None, []
    names = ["conv_id", "depth", "ends_sha256"]

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=names)

    for batch in batches:
        for conv, depth, _, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != (conv, depth):
                if at is not None:
                    found.append((*at, state.hexdigest()))
                at, state = (conv, depth), hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
            if len(found) > 4096:
                yield out()
                found.clear()
    if at is not None:
        found.append((*at, state.hexdigest()))
    if found:
        yield out()


def ends(members: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 from (conv_id, depth, member): SHA-256 over each node's members, ascending, comma-joined.

    A digest is sequential by nature, but only the digest: members are sorted and joined by ranges, and one task reads a
    node's finished pieces one after the other.
    """
    order = ["conv_id", "depth", "member"]
    packed = members.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pack, "conv_id long, depth long, first long, piece string")
    return packed.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").mapInArrow(_digest, "conv_id long, depth long, ends_sha256 string")


def trie(ids: DataFrame, seq: DataFrame) -> DataFrame:
    """The nodes of the trie of sequences: one for each distinct prefix, and the root.

    ids: conv_id, n (turns, maybe 0); seq: conv_id, pos, name, chars, names being equal for equal turns. Returns conv_id (the smallest
    member), depth, parent_conv_id (the parent's conv_id; null for the root), n_convs, n_children, n_leaves (childless nodes
    at or below it), saved_tokens (summed at and below it: (n_convs - 1) * chars of the last turn), ends_sha256 (see ends()).
    Without conversations there is no root either.
    """
    levels = blocks(seq)
    keys = staged(prefixes(levels), "prefixes")
    drop_staged(*levels)
    last = seq.select(F.col("conv_id").alias("_c"), (F.col("pos") + 1).alias("_d"), "chars")
    nodes = staged(keys.groupBy("depth", "key").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")), "nodes")
    chars = nodes.select("conv_id", "depth", "n_convs").join(last, (F.col("conv_id") == F.col("_c")) & (F.col("depth") == F.col("_d"))).select("conv_id", "depth", "n_convs", "chars")
    # A node's parent is the node of its smallest member's shorter prefix.
    up = keys.select(F.col("conv_id").alias("_c"), (F.col("depth") + 1).alias("_d"), F.col("depth").alias("_pd"), F.col("key").alias("_key"))
    shorter = nodes.select("conv_id", "depth").join(up, (F.col("conv_id") == F.col("_c")) & (F.col("depth") == F.col("_d"))).select("conv_id", "depth", "_pd", "_key")
    owner = nodes.select(F.col("depth").alias("_pd"), F.col("key").alias("_key"), F.col("conv_id").alias("up_conv"))
    parents = shorter.join(owner, ["_pd", "_key"]).select(F.col("conv_id").alias("_c"), F.col("depth").alias("_d"), "up_conv")
    spark, least = ids.sparkSession, ids.agg(F.min("conv_id").alias("c"), F.count(F.lit(1)).alias("n")).first()
    zero, top = F.lit(0).cast("long"), F.lit(least["c"]).cast("long")
    root = spark.range(min(1, least["n"])).select(top.alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("up_conv"), F.lit(least["n"]).cast("long").alias("n_convs"), zero.alias("chars"))
    below = chars.join(parents, (F.col("conv_id") == F.col("_c")) & (F.col("depth") == F.col("_d")), "left")
    below = below.select("conv_id", "depth", F.when(F.col("depth") == 1, top).otherwise(F.col("up_conv")).alias("up_conv"), "n_convs", "chars")
    tree = staged(below.unionAll(root.select(*below.columns)), "tree")
    children = tree.filter("up_conv IS NOT NULL").groupBy(F.col("up_conv").alias("_c"), (F.col("depth") - 1).alias("_d")).agg(F.count(F.lit(1)).alias("n_children"))
    own = tree.join(children, (F.col("conv_id") == F.col("_c")) & (F.col("depth") == F.col("_d")), "left").select(
        "conv_id", "depth", "up_conv", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")
    )
    own = staged(own, "own")
    drop_staged(tree)
    sums = _subtrees(own.select("conv_id", "depth", "up_conv", (F.col("n_children") == 0).cast("long").alias("leaves"), "saved"))
    deepest = ids.filter("n > 0").select(F.col("conv_id").alias("member"), F.col("n").alias("depth"))
    at_end = keys.join(deepest, (F.col("conv_id") == F.col("member")) & (keys["depth"] == deepest["depth"])).select("member", keys["depth"], "key")
    ended = at_end.join(nodes.select(F.col("depth").alias("_d"), F.col("key").alias("_key"), "conv_id"), (F.col("depth") == F.col("_d")) & (F.col("key") == F.col("_key"))).select("conv_id", "depth", "member")
    none = ids.filter("n = 0").select(top.alias("conv_id"), zero.alias("depth"), F.col("conv_id").alias("member"))
    digests = staged(ends(ended.unionAll(none)), "ends").select(F.col("conv_id").alias("_c"), F.col("depth").alias("_d"), "ends_sha256")
    drop_staged(keys, nodes)
    out = own.join(sums, ["conv_id", "depth"]).join(digests, (F.col("conv_id") == F.col("_c")) & (F.col("depth") == F.col("_d")), "left")
    return out.select(
        "conv_id", "depth", F.col("up_conv").alias("parent_conv_id"), "n_convs", "n_children", F.col("all_leaves").alias("n_leaves"), F.col("all_saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")
    )


def _subtrees(nodes: DataFrame) -> DataFrame:
    """conv_id, depth, all_leaves, all_saved: sums at and below each node, by pointers that jump twice as far each round."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    live = staged(nodes.select("conv_id", "depth", F.col("up_conv").alias("jump_conv"), (F.col("depth") - 1).alias("jump_depth"), "leaves", "saved"), "reach")
    reach = 1
    while reach <= deepest:
        # What a node within reach sums up goes to the node it points to; pointers beyond the root are null.
        given = live.filter("jump_conv IS NOT NULL").groupBy(F.col("jump_conv").alias("_c"), F.col("jump_depth").alias("_d")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        onward = live.select(F.col("conv_id").alias("_jc"), F.col("depth").alias("_jd"), F.col("jump_conv").alias("next_conv"), F.col("jump_depth").alias("next_depth"))
        added = live.join(given, (F.col("conv_id") == F.col("_c")) & (F.col("depth") == F.col("_d")), "left")
        moved = added.join(onward, (F.col("jump_conv") == F.col("_jc")) & (F.col("jump_depth") == F.col("_jd")), "left").select(
            "conv_id", "depth", F.col("next_conv").alias("jump_conv"), F.col("next_depth").alias("jump_depth"),
            (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
        )
        after = staged(moved, "reach")
        drop_staged(live)
        live, reach = after, 2 * reach
    return live.select("conv_id", "depth", F.col("leaves").alias("all_leaves"), F.col("saved").alias("all_saved"))


def shared_prefixes(conversations: DataFrame, group: int = 100, of: int = 6, **columns: str) -> DataFrame:
    """The trie of conversations rebuilt with borrowed beginnings; see turns(), rebuilt() and trie().

    Null roles and texts are empty, null turns come first, rows without a conv_id go, equal rows are turns of their own,
    texts of any length count by digest, and further columns are ignored. An empty table gives no rows.
    """
    ids, seq = rebuilt(turns(conversations, **columns), group, of)
    return trie(ids, seq)
