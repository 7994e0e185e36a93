"""Toxicity by weak supervision.

Voters are words (a lexicon) and word beginnings (patterns), mined by their log-odds on a bounded sample of labelled
rows outside the held-out fold, plus fixed patterns of shouting. A generative label model estimates each voter's
accuracy by expectation maximisation, and from the residual correlations between voters how much of each vote is an
echo of others. Its posterior labels, not the given ones, train the linear classifier that scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import pick
from lodestone.llm.labelled import remainder, sample
from lodestone.llm.vectors import Lookup, U, Words, words

#: Lengths in bytes of the word beginnings used as patterns.
BEGINNINGS = (4, 5, 6, 7)
#: A word or beginning that a text has this often is a feature of its own for each level reached.
LEVELS = (1, 2, 4)
#: Fixed pattern voters: share of capitals over a half, and exclamation marks more than one in forty bytes.
PATTERNS = 2


def tokens(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each distinct word and word beginning of each text."""
    length = w.end - w.start
    hashes, owner = [w.hashed()], [w.text]
    for k, n in enumerate(BEGINNINGS, 1):
        longer = length > n
        hashes.append(w.hashed(n)[longer] ^ U(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        owner.append(w.text[longer])
    return np.concatenate(hashes), np.concatenate(owner)


def levels(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each distinct token of each text, once for each of LEVELS that its count reaches."""
    order = np.lexsort((hashes, owner))
    h, t = hashes[order], owner[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    n = np.diff(np.append(np.flatnonzero(first), len(h)))
    h, t = h[first], t[first]
    return np.concatenate([raised(h[n >= k], i) for i, k in enumerate(LEVELS)]), np.concatenate([t[n >= k] for k in LEVELS])


def raised(hashes: np.ndarray, level: int) -> np.ndarray:
    return hashes ^ U(level * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)


def features(w: Words, lookup: Lookup) -> tuple[np.ndarray, np.ndarray]:
    """(text, place among the keys) of the keys that each text has, sorted. Only tokens that are near a key are counted."""
    h, t = tokens(w)
    near = np.zeros(len(h), bool)
    for i in range(len(LEVELS)):
        near[lookup.find(raised(h, i))[0]] = True
    h, t = levels(h[near], t[near])
    where, key = lookup.find(h)
    pair = np.unique(t[where] * max(1, len(lookup.keys)) + key)
    return pair // max(1, len(lookup.keys)), pair % max(1, len(lookup.keys))


def patterns(raw: pa.Array) -> np.ndarray:
    """The fixed pattern voters of unlowered texts: one row of PATTERNS booleans for each."""
    out = np.zeros((len(raw), PATTERNS), bool)
    for w in words(raw, lower=False):
        size = np.maximum(np.diff(w.at), 1)
        for k, hit in enumerate(((w.raw >= 65) & (w.raw <= 90), w.raw == 33)):
            total = np.concatenate([[0], np.cumsum(hit)])
            out[w.first : w.first + w.n, k] = (total[w.at[1:]] - total[w.at[:-1]]) / size > (0.5, 0.025)[k]
    return out


@dataclass
class LabelModel:
    """P(label) and, for each voter, P(vote | label 1), P(vote | label 0) the weight left after correlations, and the most its log-odds may be."""

    prior: float
    hit: np.ndarray
    false: np.ndarray
    weight: np.ndarray
    most: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(label 1 | votes) for a 0/1 matrix of texts by voters; a voter that doesn't vote abstains."""
        z = np.log(self.prior / (1 - self.prior)) + votes @ (np.minimum(np.log(self.hit / self.false), self.most) * self.weight)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_label_model(votes: np.ndarray, prior: float, odds: np.ndarray, rounds: int = 20) -> LabelModel:
    """Expectation maximisation over a 0/1 vote matrix; `odds`, each voter's log-odds as mined, give the start.

    One voter should be the silence of all others, as the rest abstain rather than vote against.
    """
    votes = votes.astype(np.float64)
    n, m = votes.shape
    model = LabelModel(prior, np.full(m, 0.5), np.full(m, 0.01), np.ones(m), np.maximum(odds, 0))
    best = np.sort(np.where(votes > 0, np.maximum(odds, 0), 0), axis=1)[:, -3:].sum(1) + votes @ np.minimum(odds, 0)  # of three votes at most
    q = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + best - 1, -30, 30)))
    for _ in range(rounds):
        model.hit = np.clip((q @ votes + 0.5) / (q.sum() + 1), 1e-4, 0.999)
        model.false = np.clip(((1 - q) @ votes + 0.05) / ((1 - q).sum() + 1), 1e-5, 0.5)
        rest = (votes - model.false) * np.sqrt(1 - q)[:, None]  # votes that agree where the label is 0 echo each other
        spread = np.sqrt((rest**2).sum(0)) + 1e-6
        corr = rest.T @ rest / np.outer(spread, spread)
        np.fill_diagonal(corr, 0)
        model.weight = 1 / (1 + np.where(corr > 0.1, corr, 0).sum(0))
        new = model.posterior(votes)
        if np.abs(new - q).max() < 1e-6:
            break
        q = new
    return model


def fit_linear(x: np.ndarray, q: np.ndarray, ridge: float = 0.1, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels; accelerated gradient steps."""
    n = max(1, len(x))
    x1 = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    v = np.ones(x1.shape[1])
    for _ in range(30):  # the largest eigenvalue bounds the curvature
        v = x1.T @ (x1 @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 1 / (0.3 * float(np.linalg.norm(x1.T @ (x1 @ v))) + ridge)
    decay = np.append(np.full(x.shape[1], ridge), 0.0)
    w = np.append(np.zeros(x.shape[1]), np.log((q.sum() + 0.5) / (n - q.sum() + 0.5)))
    last = w
    for k in range(rounds):
        at = w + k / (k + 3) * (w - last)
        p = 1 / (1 + np.exp(-np.clip(x1 @ at, -30, 30)))
        last, w = w, at - step * (x1.T @ (p - q) + decay * at)
    w, b = w[:-1], w[-1]
    return w.astype(np.float64), float(b)


@dataclass
class Model:
    """Sorted token hashes with their weights, and the bias."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array, lookup: Lookup | None = None) -> np.ndarray:
        lookup = lookup or Lookup(self.keys)
        z = np.full(len(texts), self.bias)
        for w in words(texts):
            t, key = features(w, lookup)
            np.add.at(z, w.first + t, self.weights[key])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held: int = 0, most: int = 8000, voters: int = 256,
    keep: int = 1024, doc_id: str = "doc_id", text: str = "text",
) -> Model:
    """The model, from about `most` labelled rows outside the held-out fold; without any, every score is a half less a bit."""
    chosen = sample(docs, labels, label, folds, held, most, doc_id, text).select("text", "label")
    chosen = chosen.persist()
    try:
        counted = chosen.mapInArrow(_count, "hash long, bad long, all long").groupBy("hash").agg(F.sum("bad").alias("bad"), F.sum("all").alias("all"))
        sizes = chosen.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
        n, bad = int(sizes[0]), int(sizes[1])
        if not bad or bad == n:
            return Model(np.zeros(0, np.uint64), np.zeros(0), -0.1 if not bad else 0.1)
        good = n - bad
        odds = F.log((F.col("bad") + 0.5) / (bad - F.col("bad") + 0.5)) - F.log((F.col("all") - F.col("bad") + 0.5) / (good - F.col("all") + F.col("bad") + 0.5))
        z = odds / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("all") - F.col("bad") + 0.5))
        low = odds - 1.5 * odds / F.col("z")  # a lower bound of the log-odds
        mined = counted.filter("bad >= 3").withColumn("z", z).filter("z >= 3").withColumn("low", low).filter("low >= 2.6")
        top = mined.orderBy(F.desc("low"), "hash").limit(keep).select("hash", "low").collect()
        ranked = np.array([r["hash"] for r in top], np.int64).view(np.uint64)
        if not len(ranked):
            return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(bad / good)))
        rows = chosen.mapInArrow(_matrix(ranked), "found binary, pattern binary").collect()
    finally:
        chosen.unpersist()
    x = np.zeros((len(rows), len(ranked)), np.float32)
    votes = np.zeros((len(rows), min(voters, len(ranked)) + PATTERNS), bool)
    for i, r in enumerate(rows):
        at = np.frombuffer(r["found"], np.int32)
        x[i, at] = 1
        votes[i, at[at < min(voters, len(ranked))]] = True
        votes[i, -PATTERNS:] = np.frombuffer(r["pattern"], bool)
    start = np.concatenate([[r["low"] for r in top[: votes.shape[1] - PATTERNS]], np.zeros(PATTERNS)])
    used = unlike(votes)
    cast = np.column_stack([votes[:, used], ~votes[:, used].any(1)])
    model = fit_label_model(cast, bad / n, np.append(start[used], -4))
    weights, bias = fit_linear(x, model.posterior(cast.astype(np.float64)))
    order = np.argsort(ranked)
    return Model(ranked[order], weights[order], bias)


def unlike(votes: np.ndarray, most: float = 0.9) -> np.ndarray:
    """Voters, in order, whose votes aren't nearly those of an earlier one (by Jaccard similarity)."""
    v = votes.astype(np.float64)
    both, size, kept = v.T @ v, v.sum(0), []
    for j in range(v.shape[1]):
        if size[j] and all(both[i, j] < most * (size[i] + size[j] - both[i, j]) for i in kept):
            kept.append(j)
    return np.array(kept, np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label = np.asarray(batch.column(1).to_pylist(), np.int64)
        for w in words(batch.column(0), limit=1 << 22):
            h, t = levels(*tokens(w))
            order = np.argsort(h, kind="stable")
            keys, first = np.unique(h[order], return_index=True)
            bad = np.add.reduceat(label[w.first + t[order]], first) if len(keys) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(bad), pa.array(np.diff(np.append(first, len(h))))], names=["hash", "bad", "all"]
            )


def _matrix(ranked: np.ndarray):
    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(ranked)
        lookup = Lookup(ranked[order])
        for batch in batches:
            rows: list[np.ndarray] = []
            for w in words(batch.column(0)):
                t, key = features(w, lookup)
                rows += np.split(order[key].astype(np.int32), np.searchsorted(t, np.arange(1, w.n)))
            voted = patterns(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary()), pa.array([v.tobytes() for v in voted], pa.binary())], names=["found", "pattern"])

    return matrix


def score(docs: DataFrame, model: Model, folds: int = 5, held: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs, by the whole text and nothing else.

    Null and empty texts score by the bias alone. A null doc_id is kept (its fold is that of an empty text). Repeated
    rows score alike. Empty tables give no rows; further columns are ignored. Nothing is shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = pick(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), (remainder("doc_id", folds) == held).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(sent.value.keys)
        for batch in batches:
            s = sent.value.score(batch.column(2), lookup)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
