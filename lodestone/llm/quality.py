"""Quality by a factorisation machine.

Inputs are hashed words (with their share of the text), and structure statistics and metadata (the text's size) cut
into the quantile bins of the training sample. All pairs of inputs interact through low-rank vectors, scored in linear
time: the sum over pairs of <v_i, v_j> x_i x_j is half of (the square of the sum of v_i x_i) less (the sum of squares).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import numbered_columns, pick
from lodestone.llm.labelled import remainder, sample
from lodestone.llm.vectors import U, Words, words

WORD_BITS = 13
BINS = 8
#: Bytes that are counted one by one, as shares of the text.
MARKS = b"!?.,;:*$%&#|_-@/\n\t \"'<>{}[]()=+~^\\`"
NAMES = ["bytes", "words", "word_bytes", "word_spread", "upper", "digit", "high", "distinct", "again", "again_two", "top_words", "lines", "line_bytes"]


def statistics(w: Words, hashes: np.ndarray) -> np.ndarray:
    """One row of structure statistics for each text, from its unlowered bytes; a text without bytes or words has zeros."""
    n, raw = w.n, w.raw
    size = np.diff(w.at).astype(np.float64)
    per_byte = np.maximum(size, 1)
    count = np.bincount(w.text, minlength=n).astype(np.float64)
    per_word = np.maximum(count, 1)
    length = (w.end - w.start).astype(np.float64)
    mean = np.bincount(w.text, length, n) / per_word
    spread = np.sqrt(np.maximum(np.bincount(w.text, length**2, n) / per_word - mean**2, 0))
    kind = np.zeros(256, np.int64)
    kind[65:91], kind[48:58], kind[128:] = 1, 2, 3
    for i, b in enumerate(MARKS, 4):
        kind[b] = i
    kinds = len(MARKS) + 4
    owner = np.repeat(np.arange(n), np.diff(w.at))
    share = np.bincount(owner * kinds + kind[raw], minlength=n * kinds).reshape(n, kinds) / per_byte[:, None]
    order = np.lexsort((hashes, w.text))
    h, t = hashes[order], w.text[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    distinct = np.bincount(t[first], minlength=n)
    times = np.diff(np.append(np.flatnonzero(first), len(h)))
    top = np.zeros(n)
    np.maximum.at(top, t[first], times)
    same = lambda k: np.bincount(w.text[k:][(hashes[k:] == hashes[: len(hashes) - k]) & (w.text[k:] == w.text[: len(hashes) - k])], minlength=n) / per_word
    lines = share[:, 4 + MARKS.index(b"\n")] * size + 1
    columns = [np.log1p(size), np.log1p(count), mean, spread, share[:, 1], share[:, 2], share[:, 3], distinct / per_word, same(1), same(2), top / per_word, np.log(lines), np.log1p(size / lines)]
    return np.column_stack([*columns, share[:, 4:]])


def inputs(raw: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For portions of texts: first text, statistics, and (text, bucket, value) of hashed words in order of text and bucket."""
    for w in words(raw, lower=False):
        h = w.hashed()
        pair, times = np.unique(w.text << WORD_BITS | (h >> U(64 - WORD_BITS)).astype(np.int64), return_counts=True)
        text = pair >> WORD_BITS
        total = np.sqrt(np.bincount(text, times.astype(np.float64) ** 2, w.n))
        yield w.first, statistics(w, h), text, pair & ((1 << WORD_BITS) - 1), times / total[text]


@dataclass
class Machine:
    """Bin edges of the statistics, bias, linear weights and low-rank vectors; statistics' bins come after the words."""

    edges: np.ndarray
    bias: float
    linear: np.ndarray
    vectors: np.ndarray

    def bins(self, stats: np.ndarray) -> np.ndarray:
        """The input that each statistic of each text switches on."""
        at = np.stack([np.searchsorted(e, stats[:, k], "right") for k, e in enumerate(self.edges)], 1) if len(stats) else np.zeros((0, len(self.edges)), np.int64)
        return (1 << WORD_BITS) + np.arange(len(self.edges)) * BINS + at

    def raw_score(self, n: int, text: np.ndarray, item: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score before the sigmoid, sums of v x) by the sum-of-squares identity; text must be sorted."""
        vx = self.vectors[item] * value[:, None]
        first = np.searchsorted(text, np.arange(n))
        some = np.append(first[1:], len(text)) > first
        sums, squares, flat = np.zeros((n, vx.shape[1])), np.zeros(n), np.zeros(n)
        if some.any():
            sums[some] = np.add.reduceat(vx, first[some])
            squares[some] = np.add.reduceat((vx**2).sum(1), first[some])
            flat[some] = np.add.reduceat(self.linear[item] * value, first[some])
        return self.bias + flat + ((sums**2).sum(1) - squares) / 2, sums

    def score(self, raw: pa.Array) -> np.ndarray:
        out = np.zeros(len(raw))
        for first, stats, text, item, value in inputs(raw):
            z, _ = self.raw_score(len(stats), *merged(text, item, value, self.bins(stats)))
            out[first : first + len(stats)] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


#: Weight of the words of a text against its statistics, which count 1 each.
WORD_WEIGHT = 0.3


def merged(text: np.ndarray, item: np.ndarray, value: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and bins of texts as one list in order of text."""
    n, k = bins.shape
    t = np.concatenate([text, np.repeat(np.arange(n), k)])
    order = np.argsort(t, kind="stable")
    return t[order], np.concatenate([item, bins.ravel()])[order], np.concatenate([value * WORD_WEIGHT, np.full(n * k, 1 / np.sqrt(k))])[order]


def train(stats: np.ndarray, text: np.ndarray, item: np.ndarray, value: np.ndarray, label: np.ndarray, rank: int = 8, rounds: int = 60, rate: float = 0.05) -> Machine:
    """A factorisation machine by Adam over whole-sample gradients."""
    edges = np.stack([np.quantile(stats[:, k], np.arange(1, BINS) / BINS) for k in range(stats.shape[1])])
    size = (1 << WORD_BITS) + len(edges) * BINS
    rng = np.random.default_rng(7)
    p = float(np.clip(label.mean(), 0.02, 0.98))
    m = Machine(edges, float(np.log(p / (1 - p))), np.zeros(size), rng.normal(0, 0.05, (size, rank)))
    text, item, value = merged(text, item, value, m.bins(stats))
    n, decay = len(label), 3e-4
    state = [np.zeros(size), np.zeros(size), np.zeros((size, rank)), np.zeros((size, rank)), 0.0, 0.0]
    for step in range(1, rounds + 1):
        z, sums = m.raw_score(len(label), text, item, value)
        slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) / n
        g = slope[text] * value
        flat = np.bincount(item, g, size) + decay * m.linear
        # d score / d v_i = x_i (sum of v x) - v_i x_i^2
        deep = np.stack([np.bincount(item, g * sums[text, r], size) for r in range(rank)], 1) - m.vectors * np.bincount(item, g * value, size)[:, None] + decay * m.vectors
        up = 1 / (1 - 0.9**step), 1 / (1 - 0.999**step)
        for k, (grad, target) in enumerate(((flat, m.linear), (deep, m.vectors))):
            state[2 * k] = 0.9 * state[2 * k] + 0.1 * grad
            state[2 * k + 1] = 0.999 * state[2 * k + 1] + 0.001 * grad**2
            target -= rate * state[2 * k] * up[0] / (np.sqrt(state[2 * k + 1] * up[1]) + 1e-8)
        b = float(slope.sum())
        state[4], state[5] = 0.9 * state[4] + 0.1 * b, 0.999 * state[5] + 0.001 * b * b
        m.bias -= rate * state[4] * up[0] / (np.sqrt(state[5] * up[1]) + 1e-8)
    return m


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held: int = 1, most: int = 4000, doc_id: str = "doc_id", text: str = "text") -> Machine:
    """The machine, from about `most` labelled rows outside the held-out fold; without any, it scores everything 0.5 or more.

    Inputs are made on the executors; the driver gets the statistics and hashed words of the sample only.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stats, t, item, value in inputs(batch.column(0)):
                cut = np.searchsorted(t, np.arange(len(stats) + 1))
                part = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s.tobytes() for s in stats], pa.binary()), part(item.astype(np.int32)), part(value.astype(np.float32)), batch.column(1).slice(first, len(stats))],
                    names=["stats", "items", "shares", "label"],
                )

    chosen = sample(docs, labels, label, folds, held, most, doc_id, text).select("text", "label")
    rows = chosen.mapInArrow(extract, "stats binary, items binary, shares binary, label int").collect()
    width = len(NAMES) + len(MARKS)
    if not rows:
        return Machine(np.zeros((width, BINS - 1)), 0.0, np.zeros((1 << WORD_BITS) + width * BINS), np.zeros(((1 << WORD_BITS) + width * BINS, 1)))
    rows.sort(key=lambda r: (r["label"], r["stats"], r["items"], r["shares"]))  # whatever order executors answered in
    stats = np.stack([np.frombuffer(r["stats"]) for r in rows])
    items = [np.frombuffer(r["items"], np.int32) for r in rows]
    values = np.concatenate([np.frombuffer(r["shares"], np.float32) for r in rows]).astype(np.float64)
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in items])
    return train(stats, owner, np.concatenate(items).astype(np.int64), values, np.array([r["label"] for r in rows], np.float64))


def score(docs: DataFrame, machine: Machine, folds: int = 3, held: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs, by the whole text and nothing else.

    Null texts score as empty ones. A null doc_id is kept (its fold is that of an empty text). Repeated rows score
    alike. Empty tables give no rows; further columns are ignored. Nothing is shuffled.
    """
    rows = pick(docs, doc_id=doc_id, text=text)
    return scored(rows, machine, "text").toDF("doc_id", "text", "score").select(F.col("doc_id").cast("long"), (remainder("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def scored(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """docs with its columns as numbered_columns() names them, and `score`, of the text column."""
    plain, names = numbered_columns(docs)
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    at = plain.columns.index(names[text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.score(batch.column(at)))], names=[*batch.schema.names, "score"])

    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())]))
