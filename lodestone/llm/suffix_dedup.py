"""Suffix-array dedup of byte strings: blockwise, over a difference cover.

A byte goes if it lies in a string of `length` bytes that also starts earlier. Sorting all suffixes would move every
position of the corpus; a difference cover moves few. D is a set of residues modulo v of which any two positions have one
at a common distance d < v. So two equal strings at p and q hold two cover samples, p + d and q + d, with equal windows of
length - v + 1 bytes, and only samples are ever sorted:

1. Windows of the samples are sorted, bucket by bucket, and each sample learns whether its window repeats at all.
2. Samples that repeat get their rank: the name of the context that holds every string they can be part of (v - 1 bytes
   before the window, v - 1 after it). Long ties are settled here: all strings around a sample whose context came
   earlier repeat, however long the match is.
3. What is left are the first samples of a context whose window stands in other contexts too (where near copies part, or
   around common phrases). The strings around a sample fall into four ranges by where they start, and each range shares a
   part of the context; only where that part meets another context too are the strings themselves sorted.

Buckets are ranges of fingerprints, not of leading bytes: equal strings meet just as well, and common beginnings don't make
large buckets. Each bucket is sorted by one task on its own; a bucket's size is fixed, and their number grows with the
input. The sort of names can be done in several slices, one after the other, to bound the space on disk.

Texts lie in chunks of some hundred kilobytes, in the order of documents; at that size the JVM holds them like small objects. A chunk sends a bucket each fingerprint once, so a
string that everyone shares costs one entry a chunk.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import drop_staged, few_large_tasks, pick, staged

#: Perfect difference sets: each nonzero residue is one difference of two members.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
BLOCK = 1 << 18
RANGES = 4
CHUNK = "chunk long, ids array<long>, sizes array<long>, body binary"
MARKED = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("body", pa.binary()), ("bits", pa.binary()), ("hot", pa.binary())])
SENT = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
SENT_SQL = "chunk long, bucket long, a binary, b binary"
#: In place of a bucket: what a chunk keeps for itself until the end.
OWN = -1


def cover_for(length: int) -> tuple[int, tuple[int, ...]]:
    """The largest cover whose windows are still two fifths of the strings."""
    v = max(v for v in COVERS if 5 * v <= 3 * length or v == 1)
    return v, COVERS[v]


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit words, each bit of which depends on all bits of x."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(8)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64 for i < n, and a word for each byte."""
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down), mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))


def fingerprints(body: np.ndarray, low: np.ndarray, high: np.ndarray, base: int) -> np.ndarray:
    """64 bits for each of the byte strings body[low:high]; low must ascend. Memory is bounded by blocks, not by the text."""
    out = np.empty(len(low), np.uint64)
    span = int((high - low).max()) if len(low) else 0
    up, down, words = _powers(base, BLOCK + (-(-span // 4096) + 1) * 4096)
    cuts = np.searchsorted(low, np.arange(0, len(body) + BLOCK, BLOCK))
    for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if i == j:
            continue
        at = k * BLOCK
        part = body[at : at + BLOCK + span]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(words[part] * up[: len(part)], out=total[1:])
        out[i:j] = (total[high[i:j] - at] - total[low[i:j] - at]) * down[low[i:j] - at]
    return mixed(out)


@functools.lru_cache(4)
def _template(v: int, cover: tuple[int, ...], rounds: int) -> np.ndarray:
    return (np.arange(rounds)[:, None] * v + np.array(cover)).ravel()


class Samples:
    """The cover samples of a chunk: where their windows start, and the bounds of their contexts (within their document)."""

    def __init__(self, body: bytes, sizes: list[int], length: int) -> None:
        self.length, (self.v, cover) = length, cover_for(length)
        self.window = length - self.v + 1
        self.body = np.frombuffer(body, np.uint8)
        ends = np.cumsum(np.array(sizes, np.int64))
        rounds = 1 << int(np.ceil(np.log2(max(sizes, default=0) / self.v + 2)))
        offsets = _template(self.v, cover, max(rounds, 1 << 12))
        some = [i for i, size in enumerate(sizes) if size >= length]
        counts = np.searchsorted(offsets, [sizes[i] - self.window + 1 for i in some])
        start = np.repeat(ends[some] - np.array(sizes, np.int64)[some], counts) if some else np.zeros(0, np.int64)
        self.end = np.repeat(ends[some], counts) if some else np.zeros(0, np.int64)
        self.at = start + np.concatenate([offsets[:n] for n in counts]) if some else np.zeros(0, np.int64)
        self.low = np.maximum(self.at - (self.v - 1), start)

    def only(self, keep: np.ndarray) -> Samples:
        """Some of the samples."""
        out = object.__new__(Samples)
        out.__dict__ |= self.__dict__ | {k: getattr(self, k)[keep] for k in ("at", "low", "end")}
        return out

    def windows(self) -> np.ndarray:
        return fingerprints(self.body, self.at, self.at + self.window, BASES[0])

    def contexts(self) -> np.ndarray:
        """Names of all that the strings around each sample hold, with how far it goes to both sides."""
        high = np.minimum(self.at + self.length, self.end)
        sides = (self.at - self.low).astype(np.uint64) * np.uint64(1 << 32) + (high - self.at).astype(np.uint64)
        return mixed(fingerprints(self.body, self.low, high, BASES[1]) + sides * np.uint64(BASES[0]))

    def parts(self) -> list[np.ndarray]:
        """For each of ranges(): 32 bits of what all strings share that start so far before the sample."""
        start = self.low  # a context that is cut short on the left has no strings that start further left
        return [fingerprints(self.body, np.maximum(self.at - a, start), np.minimum(self.at + self.length - b, self.end), BASES[1]).astype(np.uint32) for a, b in self.ranges()]

    def ranges(self) -> list[tuple[int, int]]:
        """How far before a sample strings start: all distances, in up to four ranges."""
        cuts = np.unique(np.linspace(0, self.v, RANGES + 1).astype(int)).tolist()
        return [(a, b - 1) for a, b in zip(cuts, cuts[1:], strict=False)]

    def last(self) -> np.ndarray:
        """The last place at which a string that holds the sample's window can start."""
        return np.minimum(self.at, self.end - self.length)


class Distinct:
    """Keys of a chunk in order of buckets, each once: its first place, and for each place which of them it has."""

    def __init__(self, key: np.ndarray, also: np.ndarray | None = None) -> None:
        sort = key if also is None else mixed(key + also * np.uint64(BASES[1]))
        order = np.argsort(sort, kind="stable")
        fresh = np.ones(len(key), bool)
        fresh[1:] = (sort[order][1:] != sort[order][:-1]) | (key[order][1:] != key[order][:-1])
        if also is not None:
            fresh[1:] |= also[order][1:] != also[order][:-1]
        first, of = order[fresh], np.empty(len(key), np.int64)
        of[order] = np.cumsum(fresh) - 1
        again = np.argsort(key[first], kind="stable")
        back = np.empty(len(first), np.int64)
        back[again] = np.arange(len(first))
        self.first, self.of = first[again], back[of]
        self.key, self.also = key[self.first], None if also is None else also[self.first]

    def repeated(self) -> np.ndarray:
        """For each key whether it has several places here."""
        return np.bincount(self.of, minlength=len(self.first)) > 1

    def rows(self, chunk: int, bits: int, slices: int = 1, at: int = 0, more: list[np.ndarray] = ()) -> Iterator[tuple]:
        """(chunk, bucket, 32 bits of each key and then of each of `more`, further words): one row for each bucket of a slice."""
        bucket = (self.key >> np.uint64(64 - bits)).astype(np.int64)
        rest = (self.key >> np.uint64(32 - bits)).astype(np.uint32)
        names, starts = np.unique(bucket, return_index=True)
        for b, i, j in zip(names.tolist(), starts, np.append(starts[1:], len(bucket))[: len(starts)], strict=True):
            if b % slices == at:
                yield chunk, b, b"".join(x[i:j].tobytes() for x in (rest, *more)), b"" if self.also is None else self.also[i:j].tobytes()


def _packed(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else schema.empty_table()


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield from _packed(held, schema).to_batches()
            held = []
    yield from _packed(held, schema).to_batches()


def _chunks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId() << 32, 0
        ids, texts, held = [], [], 0

        def row() -> tuple:
            return part + seq, ids, [len(t) for t in texts], b"".join(texts)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if texts and held + len(text) > size:
                    yield from _batches(iter([row()]), pa.schema(list(MARKED)[:4]))
                    ids, texts, held, seq = [], [], 0, seq + 1
                ids.append(i)
                texts.append(text)
                held += len(text)
        if texts:
            yield from _batches(iter([row()]), pa.schema(list(MARKED)[:4]))

    return run


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield [c[i].as_py() for c in batch.columns]


def _send_windows(length: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for chunk, sizes, body in _each(batches):
                yield from Distinct(Samples(body, sizes, length).windows()).rows(chunk, bits)

        yield from _batches(rows(), SENT)

    return run


def _joined(table: pa.Table) -> tuple[list[int], np.ndarray, list[np.ndarray], np.ndarray]:
    """chunks in order, the place where each one's entries start, and all entries' words: columns of 32 bits, and one of 64."""
    table = table.sort_by("chunk")
    a, b = (table.column(c).to_pylist() for c in ("a", "b"))
    width = len(a[0]) * 2 // len(b[0]) if b[0] else 1
    starts = np.cumsum([0, *(len(x) // 4 // width for x in a)])
    columns = [np.frombuffer(x, np.uint32).reshape(width, -1) for x in a]
    return table.column("chunk").to_pylist(), starts, [np.concatenate([c[i] for c in columns]) for i in range(width)], np.frombuffer(b"".join(b), np.uint64)


def _answer(chunks: list[int], starts: np.ndarray, bucket: int, a: np.ndarray, b: np.ndarray) -> pa.Table:
    """A row for each chunk: a bit for each of its entries, and several if there is one."""
    bits = lambda x: np.packbits(x).tobytes() if x.any() else b""
    rows = [(c, bucket, np.packbits(a[i:j]).tobytes(), bits(b[..., i:j])) for c, i, j in zip(chunks, starts[:-1], starts[1:], strict=True)]
    return _packed(rows, SENT)


def _sort_windows(hot: int):
    """Which windows other chunks have too, and which of them at least `hot` chunks have."""

    def run(table: pa.Table) -> pa.Table:
        chunks, starts, (key,), _ = _joined(table)
        ordered = np.sort(key)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        often = np.unique(ordered[hot - 1 :][ordered[hot - 1 :] == ordered[: len(ordered) - hot + 1]]) if hot <= len(ordered) else ordered[:0]
        return _answer(chunks, starts, table.column("bucket")[0].as_py(), np.isin(key, twice), np.isin(key, often))

    return run


def _sort_names(table: pa.Table) -> pa.Table:
    """Which entries an earlier chunk has too, and which parts of contexts stand in several contexts."""
    chunks, starts, (key, *parts), name = _joined(table)
    order = np.lexsort((name, key))  # stable, so the first of equal ones is of the earliest chunk
    k, n = key[order], name[order]
    later, several = np.zeros(len(k), bool), np.zeros((len(parts), len(k)), bool)
    later[order[1:]] = (k[1:] == k[:-1]) & (n[1:] == n[:-1])
    for part, out in zip(parts, several, strict=True):
        both = (key.astype(np.uint64) << np.uint64(32)) | part
        order = np.lexsort((name, both))
        x, n = both[order], name[order]
        first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        last = np.append(first[1:], len(x)) - 1
        out[order] = np.repeat(n[first] != n[last], last - first + 1)
    return _answer(chunks, starts, table.column("bucket")[0].as_py(), later, several)


def _flags(rows: list[dict], which: str, counts: dict[int, int], wide: int = 1) -> np.ndarray:
    """A chunk's answers of all buckets, in the order in which it sent its keys; `wide` rows of them."""
    plain = lambda r: np.unpackbits(np.frombuffer(r[which], np.uint8), count=wide * counts[r["bucket"]]) if r[which] else np.zeros(wide * counts[r["bucket"]], np.uint8)
    parts = [plain(r).reshape(wide, -1) for r in sorted(rows, key=lambda r: r["bucket"])]
    return np.concatenate([*parts, np.zeros((wide, 0), np.uint8)], axis=1).astype(bool)


def _counts(key: np.ndarray, bits: int) -> dict[int, int]:
    names, n = np.unique((key >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
    return dict(zip(names.tolist(), n.tolist(), strict=True))


def _mark(length: int, bits: int):
    """A chunk with a bit for each sample: whether its window repeats, and whether very many chunks have it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        (row,), answers = left.to_pylist(), right.to_pylist()
        own = Distinct(Samples(row["body"], row["sizes"], length).windows())
        counts = _counts(own.key, bits)
        again = (_flags(answers, "a", counts)[0] | own.repeated())[own.of]
        hot = _flags(answers, "b", counts)[0][own.of]
        return _packed([(row["chunk"], row["ids"], row["sizes"], row["body"], np.packbits(again).tobytes(), np.packbits(hot).tobytes() if hot.any() else b"")], MARKED)

    return run


def _named(body: bytes, sizes: list[int], bits: bytes, hot: bytes, length: int) -> tuple[Samples, Distinct, np.ndarray]:
    """The repeated samples of a chunk, their distinct (window, context), and which of these have a very common window.

    Those are dealt by window and context, so that no bucket gets all contexts of a common window.
    """
    samples = Samples(body, sizes, length)
    on = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(samples.at)).astype(bool)
    often = np.unpackbits(np.frombuffer(hot, np.uint8), count=len(on)).astype(bool)[on] if hot else np.zeros(int(on.sum()), bool)
    samples = samples.only(on)
    key, name = samples.windows(), samples.contexts()
    key[often] = mixed(key[often] + name[often])
    found = Distinct(key, name)
    return samples, found, often[found.first]


def _send_names(length: int, bits: int, slices: int, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for chunk, sizes, body, marks, hot in _each(batches):
                samples, found, _ = _named(body, sizes, marks, hot, length)
                firsts = np.sort(found.first)  # fingerprints need ascending places
                back = np.searchsorted(firsts, found.first)
                more = [p[back] for p in samples.only(firsts).parts()]
                yield from found.rows(chunk, bits, slices, at, more)

        yield from _batches(rows(), SENT)

    return run


def ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All whole numbers in the union of [low, high], each once; both ends must ascend."""
    if not len(low):
        return np.zeros(0, np.int64)
    low = np.maximum(low, np.concatenate([[low[0]], high[:-1] + 1]))
    n = np.maximum(high - low + 1, 0)
    return np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)


def _settle(length: int, bits: int):
    """What a chunk loses by its samples alone, and the strings around the samples that samples can't settle."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        (row,), answers = left.to_pylist(), right.to_pylist()
        samples, found, often = _named(row["body"], row["sizes"], row["bits"], row["hot"], length)
        counts = _counts(found.key, bits)
        reach = samples.ranges()
        (later,), several = _flags(answers, "a", counts), _flags(answers, "b", counts, len(reach)) | often
        lost = np.ones(len(samples.at), bool)
        lost[found.first] = later
        gone, places = samples.only(lost), []
        for (near, far), flags in zip(reach, several, strict=True):
            open_ = np.zeros(len(lost), bool)
            open_[found.first] = flags & ~later
            some = samples.only(open_)
            places.append(ranges(np.maximum(some.low, some.at - far), np.minimum(some.last(), some.at - near)))
        places = np.unique(np.concatenate(places))
        strings = Distinct(*(fingerprints(samples.body, places, places + length, base) for base in BASES))
        again = np.ones(len(places), bool)
        again[strings.first] = False
        low, high = np.concatenate([gone.low, places[again]]), np.concatenate([gone.last(), places[again]]) + length
        merged = np.stack(_merged(low, high, np.cumsum(row["sizes"])))
        own = (row["chunk"], OWN, merged.astype(np.uint32).tobytes(), places[strings.first].astype(np.uint32).tobytes())
        return _packed([own, *strings.rows(row["chunk"], bits)], SENT)

    return run


def _merged(low: np.ndarray, high: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that [low, high) cover; runs of two documents (which end at `ends`) stay apart."""
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order]) if len(low) else high
    doc = np.searchsorted(ends, low, side="right")
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] > high[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return low[first], high[np.append(first[1:], len(low)) - 1] if len(low) else high


KEPT = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("n_bytes", pa.int64()), ("starts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])


def _cut(length: int, bits: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        (row,), answers = left.to_pylist(), right.to_pylist()
        own = next(r for r in answers if r["bucket"] == OWN)
        runs, places = (np.frombuffer(own[c], np.uint32).astype(np.int64) for c in "ab")  # a chunk has under 2 GB
        runs = runs.reshape(2, -1)
        rest = sorted((r for r in answers if r["bucket"] != OWN), key=lambda r: r["bucket"])
        later = places[_flags(rest, "a", {r["bucket"]: r["n"] for r in rest})[0]]
        ends = np.cumsum(row["sizes"])
        low, high = _merged(np.concatenate([runs[0], later]), np.concatenate([runs[1], later + length]), ends)
        cuts = np.searchsorted(low, np.concatenate([[0], ends]))
        out, start = [], 0
        for i, end, a, b in zip(row["ids"], ends.tolist(), cuts[:-1], cuts[1:], strict=True):
            x, y = low[a:b].tolist(), high[a:b].tolist()
            kept = b"".join(row["body"][p:q] for p, q in zip([start, *y], [*x, end], strict=True))
            out.append((i, kept, end - start, [p - start for p in x], [q - p for p, q in zip(x, y, strict=True)]))
            start = end
        return _packed(out, KEPT)

    return run


def dedup_bytes(docs: DataFrame, length: int = 100, chunk_bytes: int = 240 << 10, bucket_keys: int = 8 << 20, slices: int = 1, hot: int = 1 << 16, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, kept (binary), n_bytes, starts and lengths of the maximal removed runs: one row per row of docs.

    Texts are UTF-8 bytes. A byte goes if it lies in a string of `length` bytes that also starts earlier: in a document of
    smaller doc_id, or in the same one at an earlier place (overlaps count). Strings never cross documents and are judged
    on the input. Removal may cut characters, so what is kept is binary.

    A null text is an empty one. A null doc_id counts as the largest. Rows that share a doc_id are documents of their own,
    in order of a hash of their texts; of equal rows one, whichever, is the earlier. Texts under `length` bytes lose
    nothing. Empty tables give no rows; further columns are ignored, whatever their names. A very long text makes a chunk of its
    own, which is read in blocks: beside the text and its fingerprints, nothing of its size is held.

    Fingerprints: 64 bits name a context within windows of equal fingerprints, 96 bits and more a string; they aren't
    compared byte by byte. Windows that at least `hot` chunks share are dealt by context, all others by window.
    """
    spark = docs.sparkSession
    rows = pick(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", F.col("text").cast("binary").alias("text"))
    with few_large_tasks(spark):
        plain = staged(ranged.mapInArrow(_chunks(chunk_bytes), CHUNK), "chunks")
        v, cover = cover_for(length)
        total = plain.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        bits = min(30, max(1, int(np.ceil(np.log2(max(parts, total * len(cover) / v / bucket_keys))))))

        def sort(sent: DataFrame, by) -> DataFrame:
            return sent.groupBy("bucket").applyInArrow(by, SENT_SQL)

        def each(left: DataFrame, right: DataFrame, by, schema: str) -> DataFrame:
            return left.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(by, schema)

        answers = staged(sort(plain.select("chunk", "sizes", "body").mapInArrow(_send_windows(length, bits), SENT_SQL), _sort_windows(hot)), "windows")
        marked = staged(each(plain, answers, _mark(length, bits), f"{CHUNK}, bits binary, hot binary"), "marked")
        drop_staged(plain, answers)
        parts_of = [staged(sort(marked.select("chunk", "sizes", "body", "bits", "hot").mapInArrow(_send_names(length, bits, slices, i), SENT_SQL), _sort_names), "names") for i in range(slices)]
        names = functools.reduce(DataFrame.unionAll, parts_of)
        sent = staged(each(marked, names, _settle(length, bits), SENT_SQL), "settled")
        drop_staged(*parts_of)
        strings = sent.filter(F.col("bucket") != OWN)
        later = sort(strings, _sort_names).join(strings.select("chunk", "bucket", (F.length("a") / 4).cast("int").alias("n")), ["chunk", "bucket"])
        own = sent.filter(F.col("bucket") == OWN).withColumn("n", F.lit(0))
    return each(marked.select("chunk", "ids", "sizes", "body"), own.unionAll(later.select(*own.columns)), _cut(length, bits), "doc_id long, kept binary, n_bytes long, starts array<long>, lengths array<long>")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of dedup_bytes(), as a table of its own: what is kept isn't copied."""
    removed = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    told = found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    with few_large_tasks(found.sparkSession):
        return staged(told, "digests")


ORACLE_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
z AS (SELECT doc_id, b, substr(x, 2000 * b + 1, 2198) AS y FROM d, unnest(range(0, CAST(len(x) // 2000 + 1 AS BIGINT))) AS u(b)),
s AS (SELECT doc_id, 1000 * b + i AS p, substr(y, 2 * i + 1, 200) AS w FROM z, unnest(range(0, least(1000, CAST(len(y) // 2 - 99 AS BIGINT)))) AS u(i)),
r AS (SELECT doc_id, p FROM s QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, p) > 1),
g AS (SELECT *, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 100 AS apart FROM r),
n AS (SELECT *, sum(CAST(coalesce(apart, true) AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM g),
q AS (SELECT doc_id, k, min(p) AS a, max(p) + 100 AS b FROM n GROUP BY doc_id, k),
t AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS upto FROM q),
e AS (
  SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS last_b,
    string_agg(substr(x, 2 * upto + 1, 2 * (a - upto)), '' ORDER BY a) AS kept
  FROM t JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN e.doc_id IS NULL THEN x ELSE kept || substr(x, 2 * last_b + 1) END)) AS kept_sha256
FROM d LEFT JOIN e USING (doc_id)
"""
