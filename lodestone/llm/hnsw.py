"""Approximate nearest neighbours by a hierarchical navigable small-world graph for each shard.

Distinct vectors are dealt into shards of bounded size by hash. Each shard's graph is built by inserting vectors in
batches that search the graph so far in step with each other, and is kept as flat neighbour arrays in a one-row payload.
Queries visit every shard: a shard's payload is sent to one task, once, and all queries stream past it; the shards'
results are merged. So what is moved is the index once and each query once a shard.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import drop_staged, pick, staged

#: Queries that search in step.
STEP = 512
#: Bytes of vectors, as float64, that a shard holds at most.
SHARD_BYTES = 1 << 28


class Graph:
    """Unit vectors and, for each level, a row of neighbours for each vector (-1: none)."""

    def __init__(self, vectors: np.ndarray, links: int = 16, width: int = 64, seed: int = 5) -> None:
        self.v = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        self.v = self.v.astype(np.float32)
        n = len(vectors)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(rng.random(n) + 1e-12) / np.log(links)).astype(int), 8)
        self.top = int(level.max(initial=0))
        self.near = [np.full((n, links * (2 if k == 0 else 1)), -1, np.int32) for k in range(self.top + 1)]
        self.entry = int(level.argmax()) if n else 0
        order = rng.permutation(n)
        order = np.concatenate([[self.entry], order[order != self.entry]]) if n else order
        done = min(n, 1)
        while done < n:
            batch = order[done : done + min(STEP, max(1, done))]
            self._insert(batch, level[batch], links, width)
            done += len(batch)

    def _insert(self, batch: np.ndarray, level: np.ndarray, links: int, width: int) -> None:
        q = self.v[batch]
        at = np.full((len(batch), 1), self.entry)
        mates = q @ q.T
        for k in range(self.top, -1, -1):
            inside = level >= k
            found = np.full((len(batch), width), -1)
            for mine, ef in ((~inside, 1), (inside, width)):
                if mine.any():
                    ids, _ = self.search_level(q[mine], at[mine], k, ef)
                    found[mine, : ids.shape[1]] = ids
            at = found
            if not inside.any():
                continue
            # Those of the same batch that live on this level are candidates too.
            own = np.where(inside[None, :], mates, -np.inf)
            np.fill_diagonal(own, -np.inf)
            m = min(links, len(batch))
            best = np.argpartition(-own, m - 1, axis=1)[:, :m]
            beside = np.where(np.isfinite(np.take_along_axis(own, best, 1)), batch[best], -1)
            chosen = self._diverse(batch[inside], np.hstack([found, beside])[inside], links)
            self.near[k][batch[inside], :links] = chosen
            self._reverse(k, batch[inside], chosen)

    def _diverse(self, node: np.ndarray, candidates: np.ndarray, most: int) -> np.ndarray:
        """Of each node's candidates (-1: none), up to `most` that are nearer to it than to those taken before; then the nearest others."""
        out = np.full((len(node), most), -1, np.int32)
        for i in range(0, len(node), 256):
            part = candidates[i : i + 256]
            v = self.v[part]
            sim = np.einsum("bd,bkd->bk", self.v[node[i : i + 256]], v)
            sim = np.where((part >= 0) & (part != node[i : i + 256, None]), sim, -np.inf)
            order = np.argsort(-sim, axis=1, kind="stable")
            part, sim, v = np.take_along_axis(part, order, 1), np.take_along_axis(sim, order, 1), np.take_along_axis(v, order[:, :, None], 1)
            among = np.matmul(v, v.transpose(0, 2, 1))
            taken = np.zeros(part.shape, bool)
            for c in range(part.shape[1]):
                closest = np.where(taken, among[:, c], -np.inf).max(1)
                taken[:, c] = np.isfinite(sim[:, c]) & (closest < sim[:, c]) & (taken.sum(1) < most)
            rank = np.where(taken, 0, np.where(np.isfinite(sim), 1, 2)) * part.shape[1] + np.arange(part.shape[1])
            first = np.argsort(rank, axis=1)[:, :most]
            out[i : i + 256, : first.shape[1]] = np.where(np.take_along_axis(np.isfinite(sim), first, 1), np.take_along_axis(part, first, 1), -1)
        return out

    def _reverse(self, k: int, node: np.ndarray, chosen: np.ndarray) -> None:
        """Links back to node from those it chose; a full row keeps the diverse ones of all."""
        to, back = chosen.ravel(), np.repeat(node, chosen.shape[1])
        to, back = to[to >= 0], back[to >= 0]
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        who, first, count = np.unique(to, return_index=True, return_counts=True)
        if not len(who):
            return
        extra = np.full((len(who), int(count.max())), -1, np.int64)
        extra[np.repeat(np.arange(len(who)), count), np.arange(len(to)) - np.repeat(first, count)] = back
        old = self.near[k][who].astype(np.int64)
        repeated = (extra[:, :, None] == old[:, None, :]).any(2)
        extra[repeated] = -1
        self.near[k][who] = self._diverse(who, np.hstack([old, extra]), old.shape[1])

    def search_level(self, q: np.ndarray, at: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the `ef` best found for each query on a level, from the entries `at` (-1: none), best first."""
        n, b = len(self.v), len(q)
        ef = max(ef, 1)
        seen = np.zeros((b, n), bool)
        at = at[:, : max(ef, 1)]
        ids = np.full((b, ef), -1)
        ids[:, : at.shape[1]] = at
        rows, cols = np.nonzero(ids >= 0)
        seen[rows, ids[rows, cols]] = True
        sim = np.where(ids >= 0, np.einsum("bd,bkd->bk", q, self.v[ids]), -np.inf).astype(np.float32)
        open_ = ids >= 0
        live = np.arange(b)
        while len(live):
            s = np.where(open_[live], sim[live], -np.inf)
            best = s.argmax(1)
            going = np.isfinite(s[np.arange(len(live)), best])
            live, best = live[going], best[going]
            if not len(live):
                break
            open_[live, best] = False
            near = self.near[k][ids[live, best]]
            fresh = (near >= 0) & ~seen[live[:, None], near]
            r, c = np.nonzero(fresh)
            seen[live[r], near[r, c]] = True
            new = np.where(fresh, np.einsum("bd,bkd->bk", q[live], self.v[near]), -np.inf).astype(np.float32)
            all_sim = np.hstack([sim[live], new])
            keep = np.argpartition(-all_sim, ef - 1, axis=1)[:, :ef]
            sim[live] = np.take_along_axis(all_sim, keep, 1)
            ids[live] = np.take_along_axis(np.hstack([ids[live], near]), keep, 1)
            open_[live] = np.take_along_axis(np.hstack([open_[live], fresh]), keep, 1)
            gone = ~np.isfinite(sim[live])
            open_[live] &= ~gone
        order = np.argsort(-sim, axis=1, kind="stable")
        ids, sim = np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)
        return np.where(np.isfinite(sim), ids, -1), sim

    def search(self, queries: np.ndarray, k: int, ef: int) -> np.ndarray:
        """Ids of the k best found for each query (-1: none)."""
        if not len(self.v):
            return np.full((len(queries), k), -1)
        q = (queries / np.linalg.norm(queries, axis=1, keepdims=True)).astype(np.float32)
        out = []
        for i in range(0, len(q), STEP):
            at = np.full((len(q[i : i + STEP]), 1), self.entry)
            for level in range(self.top, 0, -1):
                at, _ = self.search_level(q[i : i + STEP], at, level, 4)
            ids, _ = self.search_level(q[i : i + STEP], at, 0, max(ef, k))
            out.append(ids[:, :k])
        return np.concatenate(out) if out else np.full((0, k), -1)

    def pack(self) -> bytes:
        to = io.BytesIO()
        np.savez(to, v=self.v, entry=self.entry, **{f"near{k}": x for k, x in enumerate(self.near)})
        return to.getvalue()

    @classmethod
    def unpack(cls, payload: bytes) -> Graph:
        with np.load(io.BytesIO(payload)) as z:
            out = cls.__new__(cls)
            out.v, out.entry = z["v"], int(z["entry"])
            out.near = [z[f"near{k}"] for k in range(sum(x.startswith("near") for x in z.files))]
            out.top = len(out.near) - 1
            return out


def usable(vec: str):
    """Whether a vector takes part: not null, finite throughout and not zero."""
    return (
        F.col(vec).isNotNull()
        & F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
        & F.exists(vec, lambda x: F.coalesce(x, F.lit(0)) != 0)
    )


def _members(most: int):
    """Equal vectors of a batch as one row with their smallest ids."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, list[int]] = {}
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(tuple(v), []).append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.list_(pa.float64())), pa.array([sorted(set(x))[:most] for x in found.values()], pa.list_(pa.int64()))], names=["vec", "ids"]
            )

    return members


def build_index(vectors: DataFrame, members: int, shard_rows: int = 8192, links: int = 16, width: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """dim, shard, ids (each distinct vector's smallest `members` ids), vectors, graph: one row per shard; staged."""
    rows = pick(vectors, vec_id=vec_id, vec=embedding).filter(usable("vec") & F.col("vec_id").isNotNull())
    part = rows.select(F.col("vec_id").cast("long"), F.col("vec").cast("array<double>")).mapInArrow(_members(members), "vec array<double>, ids array<long>")
    fewest = lambda c: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), 1, members)
    salted = part.groupBy("vec", F.pmod(F.xxhash64("ids"), F.lit(64)).alias("salt")).agg(fewest("ids").alias("ids"))
    distinct = staged(salted.groupBy("vec").agg(fewest("ids").alias("ids")), "vectors")
    n, longest = distinct.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    shards = max(1, -(-n // max(1, min(shard_rows, SHARD_BYTES // (8 * (longest or 1))))))
    dealt = distinct.select(F.size("vec").alias("dim"), F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int").alias("shard"), "vec", "ids")

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ids", key=lambda c: c.map(min)).reset_index(drop=True)
        v = np.stack(rows["vec"].to_numpy())
        ids = [np.sort(np.asarray(x, np.int64)) for x in rows["ids"]]
        graph = Graph(v, links, width)
        sizes = np.array([len(x) for x in ids], np.int64)
        return pd.DataFrame({"dim": rows["dim"][:1], "shard": rows["shard"][:1], "ids": [np.concatenate(ids).tobytes()], "sizes": [sizes.tobytes()], "vectors": [v.tobytes()], "graph": [graph.pack()]})

    index = staged(dealt.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, ids binary, sizes binary, vectors binary, graph binary"), "index")
    drop_staged(distinct)
    return index


class _Shard:
    """A shard's payload, unpacked."""

    def __init__(self, ids: bytes, sizes: bytes, vectors: bytes, graph: bytes) -> None:
        self.sizes, self.ids = np.frombuffer(sizes, np.int64), np.frombuffer(ids, np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.v = np.frombuffer(vectors).reshape(len(self.sizes), -1)
        self.graph = Graph.unpack(graph)


def _found(shard: _Shard, own: np.ndarray, vectors: pa.Array, k: int, ef: int) -> pa.RecordBatch:
    """The k nearest of a shard for each of some queries, scored on the original vectors."""
    asked, out = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1), []
    for i, nodes in enumerate(shard.graph.search(asked, 2 * k + 2, ef)):
        nodes = nodes[nodes >= 0]
        score = shard.v[nodes] @ asked[i] / (np.linalg.norm(shard.v[nodes], axis=1) * np.linalg.norm(asked[i]))
        hit = sorted((-s, x) for s, n in zip(score.tolist(), nodes, strict=True) for x in shard.ids[shard.first[n] : shard.first[n] + shard.sizes[n]].tolist() if x != own[i])
        out += [(own[i], x, -s) for s, x in hit[:k]]
    columns = list(zip(*out, strict=True)) or [()] * 3
    kinds = (pa.int64(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query_id", "vec_id", "score"])


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, ef: int = 160, shard_rows: int = 8192, links: int = 16, width: int = 64,
    vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found for each row of queries (same columns as vectors).

    Nearness is the cosine in double precision on the original vectors, larger first, ties to the smaller vec_id; rows
    with the query's own id are no candidates. Vectors that are null, zero, or hold null or non-finite components, and
    rows with a null id, take no part, as candidates or queries. Vectors of different lengths are never compared.
    Equal vectors are one node of a graph, with their k + 1 smallest ids, which is all that can ever be returned; so
    copies neither bloat a graph nor cut it off. Repeated query rows are one query; different vectors under one query id are
    one query too, and a candidate counts by the nearest of them. Fewer candidates than k give fewer rows; empty tables give none;
    further columns are ignored. Measured recall is in the README.
    """
    index = build_index(vectors, k + 1, shard_rows, links, width, vec_id, embedding)
    asked = pick(queries, query_id=vec_id, vec=embedding).filter(usable("vec") & F.col("query_id").isNotNull())
    asked = asked.select(F.col("query_id").cast("long"), F.col("vec").cast("array<double>"), F.size("vec").alias("dim")).distinct()
    where = index.select(F.col("dim").alias("_dim"), F.col("shard").alias("_shard"))
    sent = asked.join(where, F.col("dim") == F.col("_dim")).select(F.col("_dim").alias("dim"), F.col("_shard").alias("shard"), "query_id", "vec")
    payload = ["ids", "sizes", "vectors", "graph"]
    left = sent.select("dim", "shard", F.lit(1).alias("kind"), "query_id", "vec", *[F.lit(None).cast("binary").alias(c) for c in payload])
    right = index.select("dim", "shard", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("array<double>").alias("vec"), *payload)
    dealt = right.unionAll(left).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            at = 0
            kinds = batch.column(2).to_numpy(zero_copy_only=False)
            for stop in [*np.flatnonzero(kinds == 0), len(kinds)]:
                for low in range(at, stop, STEP):
                    part = batch.slice(low, min(STEP, stop - low))
                    yield _found(shard, part.column(3).to_numpy(zero_copy_only=False), part.column(4), k, ef)
                if stop < len(kinds):
                    shard = _Shard(*(batch.column(5 + c)[int(stop)].as_py() for c in range(4)))
                at = stop + 1

    found = dealt.mapInArrow(search, "query_id long, vec_id long, score double")
    # Of several query rows with one id, each candidate counts once, by the nearest of them.
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
