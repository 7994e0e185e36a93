"""Substring dedup by sliding sentence spans.

Every run of several consecutive sentences is hashed, runs are joined globally, and a sentence that any
non-first repeat of a run covers is removed. Long sentences are cut at words that their own hash chooses, wherever they
stand, so that a passage within one sentence is several pieces too, and the same ones in each of its copies.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import pick, staged

#: A sentence with the white space after it: it ends at . ! ? before white space, or at a line's end.
SENTENCE = re.compile(rb"[^\x09-\x0D\x20][^.!?\n]*(?:[.!?]+[^\x09-\x0D\x20.!?][^.!?\n]*)*[.!?]*[\x09-\x0D\x20]*")
WORD = re.compile(rb"[^\x09-\x0D\x20]+[\x09-\x0D\x20]*")
#: Sentences of more words are cut, after words whose MD5 starts with fewer than this (one word in eight).
LONG = 24
CHOSEN = 32
LAST = (1 << 63) - 1


@functools.lru_cache(1 << 17)
def _ends(word: bytes) -> bool:
    return hashlib.md5(word, usedforsecurity=False).digest()[0] < CHOSEN


def pieces(text: bytes) -> list[bytes]:
    """The sentences of a text, long ones in parts; joined, they are the text without its leading white space."""
    out = []
    for sentence in SENTENCE.findall(text):
        words = WORD.findall(sentence)
        if len(words) <= LONG:
            out.append(sentence)
            continue
        at = 0
        for i, word in enumerate(words, 1):
            if i == len(words) or _ends(word.rstrip(b"\t\n\v\f\r ")):
                out.append(b"".join(words[at:i]))
                at = i
    return out


def runs(sentences: list[bytes], least: int, words: int) -> list[tuple[int, int, bytes]]:
    """(first, one past last, normal form) of the shortest runs from each sentence, and of those up to each sentence, that have `least` sentences and `words` words.

    Together they cover whatever longer run repeats, to its last sentence. A text of fewer sentences is one run if it has
    the words.
    """
    least = max(1, min(least, len(sentences)))
    split = [s.split() for s in sentences]
    total = np.concatenate([[0], np.cumsum([len(s) for s in split])]) if split else np.zeros(1, int)
    each = np.arange(len(split))
    ends = np.maximum(np.searchsorted(total, total[:-1] + words), each + least)
    starts = np.minimum(np.searchsorted(total, total[1:] - words, side="right") - 1, each + 1 - least)
    both = {(i, j) for i, j in enumerate(ends.tolist()) if j <= len(split)} | {(i, j) for j, i in enumerate(starts.tolist(), 1) if i >= 0}
    plain = [b" ".join(s) for s in split]
    return [(i, j, b" ".join(plain[i:j])) for i, j in sorted(both)]


def _hash(x: bytes) -> int:
    return xxhash.xxh3_128_intdigest(x)


RUNS = pa.schema([("h1", pa.int64()), ("h2", pa.int32()), ("ord", pa.int64()), ("rk", pa.int64()), ("nth", pa.int32())])


def _emit(least: int, words: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, order, rk, first = [], [], [], []
            for o, k, text in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2), strict=True):
                seen = set()
                for i, (_, _, plain) in enumerate(runs(pieces(text.as_buffer().to_pybytes()), least, words)):
                    x = _hash(plain)
                    if x not in seen:
                        seen.add(x)
                        h.append(x)
                        order.append(o)
                        rk.append(k)
                        first.append(i)
                if len(h) > 200_000:
                    yield _runs(h, order, rk, first)
                    h, order, rk, first = [], [], [], []
            yield _runs(h, order, rk, first)

    return emit


def _runs(h: list, order: list, rk: list, first: list) -> pa.RecordBatch:
    low = np.array([x & 0xFFFFFFFFFFFFFFFF for x in h], dtype=np.uint64).view(np.int64)
    high = np.array([(x >> 64) & 0xFFFFFFFF for x in h], dtype=np.uint32).view(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(order, pa.int64()), pa.array(rk, pa.int64()), pa.array(first, pa.int32())], schema=RUNS)


def _remove(least: int, words: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n, gone = [], [], []
            texts = batch.column(1)
            for text, starts in zip(texts, batch.column(2), strict=True):
                if not text.is_valid:
                    kept.append(None)
                    n.append(0)
                    gone.append(0)
                    continue
                raw = text.as_buffer().to_pybytes()
                parts = pieces(raw)
                drop = np.zeros(len(parts), bool)
                later = set(starts.as_py() or ())
                seen, repeated = {}, set()
                for nth, (i, j, plain) in enumerate(runs(parts, least, words)):
                    x = _hash(plain)
                    if x not in seen:
                        seen[x] = nth in later
                    elif not seen[x]:  # an earlier run of this text says the same
                        repeated.add(nth)
                    if seen[x] or nth in repeated:
                        drop[i:j] = True
                n.append(len(parts))
                gone.append(int(drop.sum()))
                kept.append(raw if not drop.any() else b"".join(p for p, d in zip(parts, drop, strict=True) if not d))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([None if x is None else x.decode() for x in kept], pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())],
                names=["doc_id", "text", "n_sentences", "n_removed"],
            )

    return remove


def dedup_spans(docs: DataFrame, sentences: int = 2, words: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text without repeated spans, n_sentences, n_removed: one row per row of docs.

    A run starts or ends at any sentence (long ones: at any of their parts) and is the shortest there with at least
    `sentences` of them and `words` words; every longer run that repeats is covered by such ones. Of equal
    runs (white space aside) the one in the smallest doc_id, and there the leftmost, stays; all sentences that another
    one covers go, with the white space after them. A text from which nothing goes is returned as it is.

    Rows that share a doc_id count as one document when firsts are chosen (so each keeps its own copy); a null doc_id
    counts as the largest. Null text: null, 0, 0. A text with fewer sentences is one run; texts with fewer words have none
    and stay. Very long texts are hashed whole; empty tables give no rows. Further columns are ignored. Runs are pre-aggregated by hash (96 bits), so a passage that everyone shares costs one row a task; the
    join that follows has both sides exchanged for it alone, so that adaptive execution can split a hot passage.
    """
    rows = pick(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    order, rk = F.coalesce("doc_id", F.lit(LAST)), F.xxhash64("text")
    found = staged(rows.filter(F.col("text").isNotNull()).select(order.alias("ord"), rk.alias("rk"), "text").mapInArrow(_emit(sentences, words), _ddl(RUNS)), "runs")
    firsts = staged(
        found.groupBy("h1", "h2").agg(F.min("ord").alias("low"), F.max("ord").alias("high")).filter("low < high").select("h1", "h2", "low"), "firsts"
    )
    later = found.join(firsts, ["h1", "h2"]).filter("ord > low").groupBy("ord", "rk").agg(F.collect_set("nth").alias("starts"))
    joined = rows.withColumns({"_o": order, "_k": rk}).join(later, (F.col("_o") == F.col("ord")) & (F.col("_k") == F.col("rk")), "left")
    return joined.select("doc_id", "text", "starts").mapInArrow(_remove(sentences, words), "doc_id long, text string, n_sentences long, n_removed long")


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


ORACLE_SQL = r"""
WITH s AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x09-\x0D\x20][^.!?\n]*(?:[.!?]+[^\x09-\x0D\x20.!?][^.!?\n]*)*[.!?]*[\x09-\x0D\x20]*') AS parts
  FROM documents),
x AS (SELECT doc_id, i, regexp_extract_all(parts[i], '[^\x09-\x0D\x20]+[\x09-\x0D\x20]*') AS ws FROM s, unnest(generate_series(1, len(parts))) AS u(i)),
y AS (SELECT doc_id, i, j, len(ws) AS n, ws[j] AS w, CASE WHEN j > 1 THEN left(md5(regexp_extract(ws[j - 1], '^[^\x09-\x0D\x20]+')), 1) IN ('0', '1') ELSE false END AS cut FROM x, unnest(generate_series(1, len(ws))) AS u(j)),
z AS (SELECT *, sum(CAST(cut AND n > 24 AS INTEGER)) OVER (PARTITION BY doc_id, i ORDER BY j) AS k FROM y),
q AS (SELECT doc_id, i AS sentence, k, string_agg(w, '' ORDER BY j) AS part FROM z GROUP BY doc_id, i, k),
p AS (
  SELECT doc_id, part, row_number() OVER (PARTITION BY doc_id ORDER BY sentence, k) AS i, count(*) OVER (PARTITION BY doc_id) AS total,
    list_filter(regexp_split_to_array(part, '[\x09-\x0D\x20]+'), lambda w: w <> '') AS ws
  FROM q),
c AS (SELECT *, len(ws) AS n, sum(len(ws)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM p),
e AS (
  SELECT a.doc_id, a.i, greatest(b.i, a.i + CASE WHEN a.total > 1 THEN 1 ELSE 0 END) AS j
  FROM c a ASOF JOIN c b ON a.doc_id = b.doc_id AND a.upto - a.n + 20 <= b.upto
  UNION SELECT b.doc_id, least(a.i, b.i - CASE WHEN b.total > 1 THEN 1 ELSE 0 END), b.i
  FROM c b ASOF JOIN c a ON a.doc_id = b.doc_id AND b.upto - 20 >= a.upto - a.n),
r AS (
  SELECT e.doc_id, e.i, e.j, string_agg(array_to_string(c.ws, ' '), ' ' ORDER BY c.i) AS run
  FROM e JOIN c ON c.doc_id = e.doc_id AND c.i BETWEEN e.i AND e.j
  GROUP BY ALL HAVING count(*) = e.j - e.i + 1),
k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS nth FROM r),
g AS (SELECT DISTINCT k.doc_id, c.i FROM k JOIN c ON c.doc_id = k.doc_id AND c.i BETWEEN k.i AND k.j WHERE nth > 1),
t AS (
  SELECT c.doc_id, count(*) AS n, count(g.i) AS gone, string_agg(CASE WHEN g.i IS NULL THEN c.part END, '' ORDER BY c.i) AS kept
  FROM c LEFT JOIN g ON g.doc_id = c.doc_id AND g.i = c.i GROUP BY c.doc_id)
SELECT s.doc_id, CASE WHEN coalesce(gone, 0) = 0 THEN s.text ELSE coalesce(kept, '') END AS text,
  CAST(coalesce(n, 0) AS BIGINT) AS n_sentences, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed
FROM s LEFT JOIN t USING (doc_id)
"""
