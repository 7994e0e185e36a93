"""Each pipeline stage against a brute-force version on the smallest tables, and the stages' contract."""

from __future__ import annotations

import corpus_pipeline
from lodestone.llm import decontamination, simhash
from lodestone.llm.common import staged
from test_other_operators import slow_fingerprint
from test_text_operators import brute_containment, brute_lines


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_filter", "line_dedup", "near_dedup", "decontamination", "packing"] and corpus_pipeline.ORACLE_SQL is None


def test_stages_on_the_smallest_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    good = corpus_pipeline.quality_filter(spark, docs, sf_dir).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in good}
    assert sum(q for i, q in labels.items() if i in kept) >= 0.9 * sum(labels.values())

    good = spark.createDataFrame(good, docs.schema)
    rows = [(r.doc_id, r.text) for r in good.collect()]
    lines = brute_lines(rows)
    short = corpus_pipeline.dedup_lines(spark, good, sf_dir)
    assert short.columns == names
    assert {r.doc_id: r.text for r in short.collect()} == {i: "\n".join(x for n, x in enumerate(t.split("\n")) if lines[i, n][1]) for i, t in rows}

    short = spark.createDataFrame(short.collect(), docs.schema)
    one = corpus_pipeline.near_dedup(spark, short, sf_dir)
    fp = {r.doc_id: slow_fingerprint(r.text, 5) for r in short.collect()}
    left, seen = set(), set()
    for i in sorted(fp):
        if i not in seen:
            left.add(i)
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in seen:
                    seen.add(j)
                    todo += [k for k in fp if (fp[j] ^ fp[k]).bit_count() <= 4]
    assert one.columns == names and {r.doc_id for r in one.collect()} == left

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = corpus_pipeline.decontaminate(spark, one, sf_dir)
    texts = {r.doc_id: r.text for r in one.collect()}
    found = {d for d, *_ in brute_containment(texts.items(), items)}
    assert clean.columns == names and {r.doc_id for r in clean.collect()} == texts.keys() - found
    assert decontamination.spell(None) == []

    packed = corpus_pipeline.pack(spark, clean, sf_dir).collect()
    assert {r.doc_id for r in packed} == texts.keys() - found and max(r.offset + r.length for r in packed) <= 2048


ODD = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "some words of a text without an id"), (4, "y " * 50_000), (5, "some words of a text without an id")]


def test_stages_on_odd_tables(spark, sf_dir):
    """Nulls, empty and very long texts, repeated rows, a missing id and clashing names: each stage gives back rows as they were."""
    rows = [(i, t, "en", "src", len(t or ""), "other", 7) for i, t in ODD]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, TEXT string, score int")
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = staged(stage(spark, df, sf_dir), name)
        assert out.columns == df.columns and stage(spark, df.limit(0), sf_dir).isEmpty(), name
        told = [(r[0], r[2:4], r[5:]) for r in out.collect()]
        assert {x[1:] for x in told} == {(("en", "src"), ("other", 7))}, name
    short = sorted((r[0] or 0, r[1] or "", r[4]) for r in stages["line_dedup"](spark, df, sf_dir).collect())
    # Equal rows stay alike; the one without an id counts as the last, so its line is the repeated one.
    assert [(i, t) for i, t, _ in short] == [(0, ""), (1, ""), (2, ""), (3, "x"), (3, "x"), (4, "y " * 50_000), (5, ODD[-1][1])]
    assert all((n or 0) == len(t) for _, t, n in short)
    near = sorted((r[0] or 0) for r in stages["near_dedup"](spark, df, sf_dir).collect())
    assert near == [1, 3, 3, 4, 5]  # texts without words are one group, and so are equal texts
    assert sorted((r[0] or 0) for r in stages["decontamination"](spark, df, sf_dir).collect()) == [0, 1, 2, 3, 3, 4, 5]
    packed = stages["packing"](spark, df, sf_dir).collect()
    assert {r.doc_id for r in packed} == {1, 2, 3, None, 4, 5} and max(r.offset + r.length for r in packed) <= 2048


def test_near_copies_of_four_fifths_go(spark, sf_dir):
    """Against brute-force Jaccard on the next larger table and on copies that lose or gain words at one place."""
    plain = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    base = [f"word{i}" for i in range(300)]
    made = [" ".join(base), " ".join(base[:250]), " ".join([*base[:120], *[f"new{i}" for i in range(25)], *base[120:]]), " ".join(base[:230]), " ".join(base[100:])]
    rows = [(r.doc_id, r.text) for r in plain] + [(10_000_000 + i, t) for i, t in enumerate(made)]
    sets = {i: set(zip(*[t.lower().split()[k:] for k in range(5)], strict=False)) for i, t in rows}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {(a, b) for v in holders.values() for k, b in enumerate(v) for a in v[:k]}
    near = {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    fp = {i: slow_fingerprint(t, 5) for i, t in rows}
    assert sum((fp[a] ^ fp[b]).bit_count() > 4 for a, b in near) > 5
    component = {r.doc_id: r.component_id for r in simhash.near_duplicates(table(spark, rows), shingle=5, bits=4, similar=(4, 5)).collect()}
    assert [p for p in near if component[p[0]] != component[p[1]]] == []
    root = {i: i for i in fp}  # nothing else is connected

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fp)
    close = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 4]
    for a, b in [*near, *close]:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert component == {i: find(i) for i in ids}
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, table(spark, rows), sf_dir).collect()}
    assert kept == {i for i in ids if find(i) == i} and {10_000_000, 10_000_004} <= kept
