"""Best-fit packing of tokenised documents in bulk-synchronous rounds.

Pieces and gaps (free ends of sequences) are range-sorted by size. Sizes are whole numbers up to the capacity, so a
sorted range of equal pieces or gaps is one run, and a run is known by its size and its ranks: a round sweeps the runs,
largest pieces first, matches each with its successor among the gaps (the smallest gap that holds it), settles
conflicts by rank (the first pieces of a run take the first gaps, the rest go on to the next gap, or to the next
round), and updates the gaps. What rounds need is the number of pieces of each size, at most `capacity` rows, however
many pieces there are; their outcome, a few thousand rank ranges, goes back to the executors, which look up each piece.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import buckets_for, numbered, pick, staged

#: Splits text as the byte-level vocabulary does (fixed by its tokenizer).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries that a worker keeps of the ids of words it has met.
REMEMBERED = 500_000
CHUNK = 4096


def _byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary names each byte: printable ones themselves, others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    Each distinct word goes through the tokenizer once and is then remembered. That is right because the tokenizer
    merges within words only; texts with characters beyond U+024F, for which Unicode tables of different versions may
    disagree on where words end, go through it whole.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.split = regex.compile(SPLIT).findall
        self.odd = regex.compile("[^\u0000-\u001b -\u0084\u0086-ɏ]").search
        self.merge = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if self.odd(text):
            return self.whole(text)
        parts = self.split(text)
        known = self.known
        if new := {p for p in parts if p not in known}:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = set(parts)
            for p in new:
                ids = [t.id for t in self.merge(p.encode().decode("latin-1").translate(self.letters))]
                known[p] = np.array(ids, "<u4").tobytes()
        return b"".join(map(known.__getitem__, parts))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: only longer ones are cut, and only the first piece may be shorter."""
    first = length % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, spread long"


def tokenised(docs: DataFrame, tokenizer: str, capacity: int, end: int, doc_id: str, text: str) -> DataFrame:
    """The pieces of every document's ids and end mark; spread is a hash that deals equal sizes out evenly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, mark = encoder(tokenizer), np.array([end], "<u4").tobytes()
        for batch in batches:
            rows = []
            for key, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = (encode(s) if (s := x.as_py()) else b"") + mark
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    rows.append((key, k, start, length, crc, zlib.crc32(f"{key}/{k}".encode())))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return pick(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


#: (size, first rank, one past the last rank, first sequence, pieces for each sequence, offset of the first of them)
Match = tuple[int, int, int, int, int, int]


def pack(counts: dict[int, int], capacity: int) -> tuple[list[Match], int]:
    """(matches, sequences used) for so many pieces of each size.

    Gaps are runs too: room -> ranges of sequences with that much free. A round is one piece size, from the largest
    down: its pieces are matched with the smallest gap that holds them, found by bisection among the gap sizes; a gap
    takes as many of them as fit, for it stays the smallest that does; pieces left over open sequences. So the sequences
    are those of item-by-item best-fit-decreasing.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    out: list[Match] = []
    used = 0

    def offer(room: int, low: int, high: int) -> None:
        if room and low < high:
            if room not in gaps:
                gaps[room] = []
                bisect.insort(rooms, room)
            gaps[room].append((low, high))

    for size in sorted((s for s, n in counts.items() if n), reverse=True):
        rank, end = 0, counts[size]
        while rank < end:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                new = -(-(end - rank) // (capacity // size))
                offer(capacity, used, used + new)
                used += new
                continue
            room = rooms[at]
            low, high = gaps[room].pop()
            if not gaps[room]:
                del gaps[room]
                rooms.pop(at)
            each = min(room // size, end - rank)
            take = min(high - low, (end - rank) // each)
            out.append((size, rank, rank + take * each, low, each, capacity - room))
            rank += take * each
            offer(room, low + take, high)
            offer(room - each * size, low, low + take)
    return out, used


def best_fit(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of each row of docs.

    A document is its ids and the id `end`; a null text has the end only, as an empty one has. Documents over the
    capacity are cut into pieces of it, and the first piece may be shorter. Pieces go into as few sequences as the
    rounds find. Rows that repeat are documents of their own; a null doc_id is kept. Empty tables give no rows; further
    columns are ignored. Texts are tokenised where they are read and never moved.
    """
    spark = docs.sparkSession
    pieces = staged(tokenised(docs, tokenizer, capacity, end, doc_id, text), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    matches, _ = pack(counts, capacity)
    kinds = T.StructType([T.StructField(n, T.LongType()) for n in ("length", "chunk", "low", "high", "first", "each", "base")])
    plan = spark.createDataFrame([(s, c, a, b, q, e, o) for s, a, b, q, e, o in matches for c in range(a // CHUNK, (b - 1) // CHUNK + 1)], kinds)
    n = sum(counts.values())
    ranked = numbered(pieces, "length", F.col("spread"), [F.col("spread"), F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], "rank", buckets_for(n))
    placed = ranked.withColumn("chunk", F.floor(F.col("rank") / CHUNK)).join(plan, ["length", "chunk"]).filter("rank >= low AND rank < high")
    nth = F.col("rank") - F.col("low")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("base") + nth % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )
