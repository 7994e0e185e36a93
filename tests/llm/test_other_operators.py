"""Sharding, nearest neighbours, SimHash and the classifiers: brute force, exact laws, held-out accuracy and odd inputs."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import components, hnsw, quality, queries, sharding, simhash, toxicity
from lodestone.llm.vectors import shingles, words

DOCS = "doc_id long, text string, TEXT string, shard int, fp int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "other", 1, 2) for i, t in rows], DOCS)


# --- op 4


@given(st.lists(st.integers(1, 50), min_size=1, max_size=120), st.integers(50, 90))
@settings(max_examples=150, deadline=None)
def test_best_fit_equals_item_by_item(sizes, capacity):
    segments, used = sharding.best_fit(sorted(Counter(sizes).items(), reverse=True), capacity)
    room, bins = [], 0
    for s in sorted(sizes, reverse=True):
        fit = min((r for r in room if r >= s), default=None)
        if fit is None:
            bins, fit = bins + 1, capacity
        else:
            room.remove(fit)
        room.append(fit - s)
    load = Counter()
    for size, a, b, k in segments:
        load[k] += size * (b - a)
    assert used == bins and max(load.values()) <= capacity and sum(load.values()) == sum(sizes)


def test_shards(spark):
    rows = [(i, "t" * (i % 37)) for i in range(400)] + [(500 + i, "copy") for i in range(30)] + [(900, None), (None, "copy"), (901, ""), (902, "")]
    out = sharding.shard(docs(spark, rows), 8).collect()
    assert len(out) == len(rows) and {r.law for r in out} == {"bytes"} and {r.shard for r in out} <= set(range(8))
    for k in range(8):
        assert sorted(r.slot for r in out if r["shard"] == k) == list(range(sum(r["shard"] == k for r in out)))
    load = Counter()
    for r in out:
        load[r["shard"]] += r["size"]
    where = defaultdict(set)
    by_id = defaultdict(list)
    for r in out:
        by_id[r.doc_id].append(r)
    for i, t in rows:
        r = by_id[i][0]
        assert r["size"] == len((t or "").encode()) + 1 and r.text_crc32 == zlib.crc32((t or "").encode())
        where[t].add(r["shard"])
    assert all(len(v) == 1 for v in where.values())
    assert max(load.values()) - min(load.values()) <= max(sum(r["size"] for r in out if r.text_crc32 == c) for c in {r.text_crc32 for r in out})
    assert sharding.shard(docs(spark, []), 8).isEmpty()


def test_fixed_capacity(spark):
    out = sharding.shard(docs(spark, [(i, "x" * (20 + i % 50)) for i in range(300)]), shards=None, capacity=2000).collect()
    load = Counter()
    for r in out:
        load[r["shard"]] += r["size"]
    assert max(load.values()) <= 2000 and len(load) <= 1.15 * sum(load.values()) / 2000 + 1


# --- op 5


def test_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 24))
    v = (centres[rng.integers(0, 12, 3000)] + 0.6 * rng.normal(size=(3000, 24))).astype(np.float32)
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = hnsw.nearest(df, df.filter("vec_id % 50 = 0"), 5, shard_rows=1100).collect()
    d = v.astype(float)
    unit = d / np.linalg.norm(d, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 50):
        s = unit @ unit[q]
        s[q] = -9
        best = sorted(range(3000), key=lambda i: (-s[i], i))[:5]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and all(abs(s[i] - x) < 1e-12 for _, i, x in mine)
        hits += len({m[1] for m in mine} & set(best))
    assert hits / (60 * 5) >= 0.95


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [None, 1.0]), (8, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (9, []), *[(10 + i, [1.0, 0.0]) for i in range(20)]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in hnsw.nearest(df, df.filter("vec_id in (0, 3, 4, 8)"), 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 10), (3, 1, 0), (3, 2, 1), (3, 3, 2)]
    assert hnsw.nearest(df.limit(0), df, 3).isEmpty()
    twice = df.filter("vec_id in (0, 3)").unionAll(df.filter("vec_id = 0"))
    assert [(r.query_id, r["rank"], r.vec_id) for r in hnsw.nearest(df, twice, 3).orderBy("query_id", "rank").collect()] == got


# --- op 8


def slow_fingerprint(text, k):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = [x for x in raw.replace(b"\n", b" ").replace(b"\t", b" ").split(b" ") if x]
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_trie_join_against_brute_force():
    rng = np.random.default_rng(1)
    k = rng.integers(0, 2**63, 500, dtype=np.uint64)
    flips = [k[:200] ^ (np.uint64(m) << np.uint64(s)) for m, s in ((1, 3), (3, 30), (7, 50), (15, 60), (31, 10))]
    k = np.unique(np.concatenate([k, *flips, np.arange(40, dtype=np.uint64)]))
    for budget in (0, 2, 4):
        want = {(i, j) for i in range(len(k)) for j in range(i + 1, len(k)) if int(k[i] ^ k[j]).bit_count() <= budget}
        got = [(i, j) for a, b in simhash.self_join(k, budget) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        assert len(got) == len(set(got)) and set(got) == want


def test_near_duplicates(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(5, base), (3, base + " tail"), (9, base.upper()), (7, "few words"), (8, "Few Words"), (10, None), (11, ""), (12, " \n"), (None, "few words"), (20, "quite other text of its own here"), (5, base)]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    fp = {i: slow_fingerprint(t, 4) for i, t in rows}
    for r in got:
        assert r.fingerprint == format(fp[r.doc_id], "016x")
        near, todo = set(), [r.doc_id]
        while todo:
            i = todo.pop()
            if i not in near:
                near.add(i)
                todo += [j for j in fp if (fp[i] ^ fp[j]).bit_count() <= 4]
        assert r.component_id == min(x for x in near if x is not None)
    assert len(got) == len(rows)
    assert simhash.near_duplicates(docs(spark, [])).isEmpty()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(1, 1), (2, 3), (3, 2)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 141)} == {100} and {got[i] for i in (7, *range(200, 260))} == {7} and got[3] == got[2] == 2
    assert components.components(spark.createDataFrame([], "a long, b long")).isEmpty()


# --- shared vector code


def test_word_hashes_tell_words_apart():
    import pyarrow as pa

    texts = ["Ab cd", "", None, "ab-cd éf", "cd" * 3, "ab cd ef gh"]
    seen = defaultdict(set)
    for limit in (1, 7, 1 << 20):
        for w in words(pa.array(texts), limit=limit):
            for h, s, e in zip(w.hashed().tolist(), w.start, w.end, strict=True):
                seen[bytes(w.raw[s:e])].add(h)
    assert set(seen) == {b"ab", b"cd", "éf".encode(), b"cdcdcd", b"ef", b"gh"} and all(len(v) == 1 for v in seen.values()) and len({min(v) for v in seen.values()}) == 6
    (w,) = words(pa.array(texts))
    assert np.bincount(shingles(w, 2)[1], minlength=6).tolist() == [1, 0, 0, 2, 0, 3]


# --- ops 9 and 10


@pytest.mark.parametrize(("name", "label", "folds", "held", "least"), [("op9_toxicity", "toxic", 5, 0, 0.9), ("op10_quality", "quality", 3, 1, 0.93)])
def test_held_out_accuracy(spark, name, label, folds, held, least):
    folder = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, folder).collect()
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    right = [r.predicted == labels[r.doc_id] for r in got if r.held_out and r.doc_id in labels]
    assert sum(right) / len(right) >= least


def test_classifiers_on_odd_tables(spark):
    labels = spark.createDataFrame([(i, i % 2, i % 2, 5) for i in range(60)] + [(1, None, None, 5), (999, 1, 1, 5)], "doc_id long, toxic int, quality int, text int")
    rows = [(i, "vile idiot talk" if i % 2 else "mild and plain talk") for i in range(60)] + [(70, None), (71, ""), (None, "idiot"), (72, "idiot " * 30_000)]
    d = docs(spark, rows)
    t = {r.doc_id: r for r in toxicity.score(d, toxicity.fit(d, labels)).collect()}
    assert t[72].predicted == 1 and t[70].predicted == t[71].predicted == 0 and t[70].score == t[71].score and len(t) == 64
    q = {r.doc_id: r for r in quality.score(d, quality.fit(d, labels)).collect()}
    assert len(q) == 64 and q[70].score == q[71].score
    assert [q[i].predicted for i in range(40)] == [i % 2 for i in range(40)]
    for module in (toxicity, quality):
        model = module.fit(d, labels.limit(0))
        assert module.score(d, model).count() == 64 and module.score(d.limit(0), model).isEmpty()


def test_square_of_sums_identity():
    rng = np.random.default_rng(0)
    m = quality.Machine(np.zeros((0, 7)), 0.3, rng.normal(size=9), rng.normal(size=(9, 3)))
    text, item, value = np.array([0, 0, 0, 2, 2]), np.array([1, 4, 8, 0, 3]), rng.normal(size=5)
    z, _ = m.raw_score(3, text, item, value)
    for t in range(3):
        at = np.flatnonzero(text == t)
        want = 0.3 + sum(m.linear[item[i]] * value[i] for i in at) + sum(m.vectors[item[i]] @ m.vectors[item[j]] * value[i] * value[j] for i in at for j in at if i < j)
        assert z[t] == pytest.approx(want)


def test_label_model_discounts_echoes():
    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.2
    one, two = np.where(y, rng.random(4000) < 0.6, rng.random(4000) < 0.05), np.where(y, rng.random(4000) < 0.5, rng.random(4000) < 0.05)
    votes = np.column_stack([one, one ^ (rng.random(4000) < 0.01), two, ~(one | two)])
    model = toxicity.fit_label_model(votes, 0.2, np.array([2.0, 2.0, 2.0, -3.0]))
    assert model.weight[0] < 0.7 < model.weight[2]
    assert ((model.posterior(votes.astype(float)) > 0.5) == y).mean() > 0.85
