"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked by a binary trie self-join.

Fingerprints that differ in at most `bits` bits agree in at least one of bits + 1 blocks. So for each block one trie is
built whose first levels are that block: below a node that ends the block no error has been spent, and its subtrie is
joined with itself as one task. The join walks pairs of nodes down together, adds up the bits in which they differ, and
drops a pair as soon as it exceeds the budget. Each task passes on a spanning forest of the links it finds, not all of
them, and components are merged by components().
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import minhash
from lodestone.llm.common import drop_staged, pick, staged
from lodestone.llm.components import components

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 42
#: Pairs of trie nodes that are handled at once.
PORTION = 1 << 20


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 hashes of the word shingles, in order and with repeats; none for a text without words."""
    tokens = WORDS.findall(text.lower())  # bytes: A-Z only
    if not tokens:
        return np.zeros(0, "<u8")
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= shingle:
        return np.array([digest(b" ".join(tokens), SEED)], "<u8")
    plain = b" ".join(tokens)
    at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in tokens])]).tolist()
    return np.array([digest(plain[a : b - 1], SEED) for a, b in zip(at, at[shingle:], strict=False)], "<u8")


def majority(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; zero for none."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = hashes[i : i + (1 << 15)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, shingle: int) -> int:
    """Bit i is set if it is set in over half of the XXH64 hashes of the word shingles; zero for a text without words."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int, doc_id: str, text: str, sketched: bool = False) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long, for every row; if sketched, also what minhash.merges() needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = (shingle_hashes(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in batch.column(1))
            if not sketched:
                out = np.array([majority(h) for h in hashes], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])
                continue
            fp, size, bands = [], [], []
            for h in hashes:
                fp.append(majority(h))
                distinct = np.unique(h)
                size.append(len(distinct))
                bands.append(minhash.bands(distinct))
            signed = pa.array(np.array(fp, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), signed, batch.column(2), pa.array(size, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "fp", "tk", "size", "bands"]
            )

    rows = pick(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), "text", *([F.xxhash64("text").alias("tk")] if sketched else []))
    return rows.mapInArrow(run, "doc_id long, fp long" + (", tk long, size long, bands array<long>" if sketched else ""))


def self_join(keys: np.ndarray, budget: int, depth: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of sorted distinct unsigned 64-bit keys that differ in at most `budget` bits.

    The trie is implicit: a node is a range of the sorted keys that share its path, cut in two by the next bit. Pairs
    of nodes and the bits spent on them are walked level by level in portions, deepest portion first.
    """
    n = len(keys)
    if n < 2:
        return
    root = np.array([[0, n, 0, n]])
    stack = [(depth, root, np.zeros(1, np.int8))]
    while stack:
        level, pair, spent = stack.pop()
        lone = (pair[:, 1] - pair[:, 0]) * (pair[:, 3] - pair[:, 2]) <= 16
        if level == 64:
            lone[:] = True
        if lone.any():
            yield from _leaves(keys, pair[lone], budget)
            pair, spent = pair[~lone], spent[~lone]
        if not len(pair):
            continue
        bit = np.uint64(63 - level)
        middle = lambda low, high: _cut(keys, low, high, bit)
        a, b = middle(pair[:, 0], pair[:, 1]), middle(pair[:, 2], pair[:, 3])
        same = (pair[:, 0] == pair[:, 2]) & (pair[:, 1] == pair[:, 3])
        low0, low1 = np.column_stack([pair[:, 0], a]), np.column_stack([a, pair[:, 1]])
        high0, high1 = np.column_stack([pair[:, 2], b]), np.column_stack([b, pair[:, 3]])
        children = [(low0, high0, spent, None), (low1, high1, spent, None), (low0, high1, spent + 1, None), (low1, high0, spent + 1, ~same)]
        made, cost = [], []
        for x, y, s, only in children:
            keep = (x[:, 1] > x[:, 0]) & (y[:, 1] > y[:, 0]) & (s <= budget)
            if only is not None:
                keep &= only
            made.append(np.hstack([x[keep], y[keep]]))
            cost.append(s[keep])
        pairs, costs = np.concatenate(made), np.concatenate(cost)
        for i in range(0, len(pairs), PORTION):
            stack.append((level + 1, pairs[i : i + PORTION], costs[i : i + PORTION]))


def _cut(keys: np.ndarray, low: np.ndarray, high: np.ndarray, bit: np.uint64) -> np.ndarray:
    """For ranges whose keys agree above `bit`: where the keys with that bit begin, by a bisection of all ranges at once."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) >> 1
        one = ((keys[np.minimum(mid, len(keys) - 1)] >> bit) & np.uint64(1)).astype(bool)
        high = np.where(open_ & one, mid, high)
        low = np.where(open_ & ~one, mid + 1, low)
    return low


def _leaves(keys: np.ndarray, pair: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among the few keys below each pair of nodes."""
    width = (pair[:, 3] - pair[:, 2]).astype(np.int64)
    times = (pair[:, 1] - pair[:, 0]) * width
    for i in range(0, len(pair), PORTION):
        t = times[i : i + PORTION]
        owner = np.repeat(np.arange(i, i + len(t)), t)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(t) - t, t)
        a, b = pair[owner, 0] + nth // width[owner], pair[owner, 2] + nth % width[owner]
        near = (a < b) & (np.bitwise_count(keys[a] ^ keys[b]) <= budget)
        if near.any():
            yield a[near], b[near]


class Forest:
    """Union-find over 0 .. n-1 with vectorised batches: links are hooked by minima, paths halved."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            a, b, low, high = a[apart], b[apart], np.minimum(ra, rb)[apart], np.maximum(ra, rb)[apart]
            np.minimum.at(self.parent, high, low)

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[x]
            if (up == x).all():
                return x
            self.parent[x] = self.parent[up]
            x = self.parent[up]


def blocks(bits: int) -> list[tuple[int, int]]:
    """(first bit from the top, bits) of each of the bits + 1 blocks of a fingerprint."""
    edge = [64 * i // (bits + 1) for i in range(bits + 2)]
    return [(a, b - a) for a, b in zip(edge, edge[1:], strict=False)]


def links(distinct: DataFrame, bits: int) -> DataFrame:
    """a, b: links between distinct fingerprints (fp long) that join all that differ in at most `bits` bits.

    Links are the spanning forests of the tries' subtrees. A subtree goes to the executors as rows of (block, path, fp);
    its task holds the fingerprints of one subtree, which is 1/2^(64/(bits+1)) of random ones.
    """
    parts = blocks(bits)
    unsigned = lambda a, n: F.shiftrightunsigned(F.shiftleft("fp", a) if a else F.col("fp"), 64 - n)
    copies = F.explode(F.array(*[F.struct(F.lit(i).alias("block"), unsigned(a, n).alias("path")) for i, (a, n) in enumerate(parts)]))
    rows = distinct.select("fp", copies.alias("c")).select("fp", F.col("c.block").alias("block"), F.col("c.path").alias("path"))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if len(batch) and (len(held) > 1 or batch["path"].iloc[0] != batch["path"].iloc[-1] or batch["block"].iloc[0] != batch["block"].iloc[-1]):
                whole = pd.concat(held) if len(held) > 1 else batch
                last = (whole["block"] == whole["block"].iloc[-1]) & (whole["path"] == whole["path"].iloc[-1])
                yield from subtrees(whole[~last])
                held = [whole[last]]
        if held:
            yield from subtrees(pd.concat(held))

    def subtrees(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        out: list[np.ndarray] = []
        for block, part in rows.groupby(["block"], sort=True):
            first, width = parts[block[0]]
            path, fp = part["path"].to_numpy(), part["fp"].to_numpy()
            order = np.argsort(path, kind="stable")
            path, fp = path[order], fp[order]
            edge = np.flatnonzero(np.append(True, path[1:] != path[:-1]))
            for i, j in zip(edge, np.append(edge[1:], len(path)), strict=True):
                if j - i > 1:
                    out += subtree(fp[i:j], first, width)
        if out:
            found = np.concatenate(out)
            yield pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    def subtree(fp: np.ndarray, first: int, width: int) -> list[np.ndarray]:
        u = np.unique(fp.view(np.uint64))
        turned = u if not first else (u << np.uint64(first)) | (u >> np.uint64(64 - first))  # the block comes first
        order = np.argsort(turned)
        keys, forest, any_ = turned[order], Forest(len(u)), False
        for a, b in self_join(keys, bits, width):
            forest.link(a, b)
            any_ = True
        if not any_:
            return []
        root = forest.roots(np.arange(len(u)))
        child = np.flatnonzero(root != np.arange(len(u)))
        back = u[order].view(np.int64)
        return [np.column_stack([back[child], back[root[child]]])]

    dealt = rows.repartition("block", "path").sortWithinPartitions("block", "path")
    return dealt.mapInPandas(join, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, bits: int = 4, doc_id: str = "doc_id", text: str = "text", similar: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, fingerprint, component_id: one row per row of docs.

    Texts are lower-cased A-Z only and cut into words at ASCII white space; a text with fewer words than `shingle` is
    one shingle, one without words (or null) has fingerprint zero. Rows whose fingerprints are connected by differences
    of at most `bits` bits share a component_id, the smallest doc_id among them. A null doc_id is kept and is never the
    smallest, unless there is no other. Repeated rows are rows of their own. Empty tables give no rows; further columns
    are ignored. Copies count as one fingerprint throughout, so groups of copies cost nothing.

    With `similar` = (num, den), texts whose shingle sets have a Jaccard similarity of num/den or more are connected
    too, however far apart their fingerprints are (see minhash).
    """
    marked = staged(fingerprints(docs, shingle, doc_id, text, similar is not None), "fingerprints")
    distinct = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = components(links(distinct.select("fp"), bits))
    rooted = staged(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "rooted")
    drop_staged(distinct, roots)
    if similar is not None:
        known = marked.join(rooted.select(F.col("fp").alias("_fp"), "root"), F.col("fp") == F.col("_fp")).select("tk", "root", "size", "bands")
        moves = minhash.merges(known, pick(docs, text=text), shingle, *similar)
        merged = staged(rooted.join(moves, "root", "left").select("fp", "low", F.coalesce("to", "root").alias("root")), "rooted")
        drop_staged(rooted, moves)
        rooted = merged
    least = staged(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "least")
    classes = staged(rooted.join(least, "root").select(F.col("fp").alias("_fp"), "component_id"), "classes")
    drop_staged(rooted, least)
    return marked.join(classes, F.col("fp") == F.col("_fp")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
