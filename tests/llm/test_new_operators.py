"""Suffix dedup, the prefix trie and spelling variants against brute force, with odd inputs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import prefix_trie, queries, spelling, suffix_dedup
from oracle import duck_rows, spark_rows

# --- op 11


def brute_bytes(rows, length):
    """doc_id -> (kept bytes, removed runs)."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - length + 1):
            if raw[p : p + length] in seen:
                gone[p : p + length] = [True] * length
            seen.add(raw[p : p + length])
        out[i] = bytes(c for c, x in zip(raw, gone, strict=True) if not x), sum(x and (j == 0 or not gone[j - 1]) for j, x in enumerate(gone))
    return out


def kept(found):
    return {r.doc_id: (bytes(r.kept), len(r.starts)) for r in found.collect()}


@pytest.mark.parametrize("v", sorted(suffix_dedup.COVERS))
def test_covers(v):
    assert {(a - b) % v for a in suffix_dedup.COVERS[v] for b in suffix_dedup.COVERS[v]} == set(range(v))


def test_fingerprints_tell_strings_apart():
    body = np.frombuffer(bytes(random.Random(1).choices(b"ab", k=700_000)), np.uint8)
    low = np.sort(np.random.default_rng(2).integers(0, 699_000, 5000))
    high = low + 12
    got = suffix_dedup.fingerprints(body, low, high, suffix_dedup.BASES[0])
    names = {}
    for x, a, b in zip(got.tolist(), low, high, strict=True):
        assert names.setdefault(body[a:b].tobytes(), x) == x
    assert len(set(names.values())) == len(names)


@pytest.mark.parametrize(("length", "letters", "hot", "slices"), [(8, "ab", 1 << 16, 1), (12, "abc", 2, 2), (40, "ab", 3, 3), (1, "abcdefghij", 1 << 16, 2)])
def test_bytes_as_by_hand(spark, length, letters, hot, slices):
    rng = random.Random(length)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 150))) for _ in range(10)]
    rows = [(i, "".join(rng.choice(base)[rng.randint(0, 60) :][: rng.randint(0, 90)] for _ in range(rng.randint(0, 3)))) for i in range(60)]
    rows += [(-5, None), (70, ""), (None, base[0] * 3), (71, "é" * 60), (72, "xé" * 40), (73, "é" * 59)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, TEXT string, chunk int")
    assert kept(suffix_dedup.dedup_bytes(docs, length, chunk_bytes=300, hot=hot, slices=slices)) == brute_bytes(rows, length)


def test_bytes_of_repeated_rows_long_texts_and_empty_tables(spark):
    text = "".join(random.Random(4).choices("abcdefgh", k=300))
    same = spark.createDataFrame([(1, text), (1, text), (1, text), (None, text), (None, "q" * 400_000)], "doc_id long, text string")
    out = suffix_dedup.dedup_bytes(same, chunk_bytes=500).collect()
    assert sorted(len(r.kept) for r in out if r.doc_id == 1) == [0, 0, 300]
    # A long run of one letter: its first string stays, and every later one overlaps it.
    assert sorted((len(r.kept), r.n_bytes) for r in out if r.doc_id is None) == [(0, 300), (1, 400_000)]
    assert suffix_dedup.dedup_bytes(same.limit(0)).collect() == []


def test_bytes_of_documents(spark, sf_dir):
    assert spark_rows(queries.op11_suffix_dedup(spark, sf_dir)) == duck_rows(suffix_dedup.ORACLE_SQL, sf_dir)


# --- op 12

NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}:{x}".encode()).digest(), r, x))
    own = {c: [v[3:] for v in sorted(vs)] for c, vs in own.items()}
    seqs = {c: own.get(c - c % 100, [])[: (h := zlib.crc32(str(c).encode()) % 6)] + v[h:] for c, v in own.items()}
    nodes, children, leaves, saved = defaultdict(list), defaultdict(set), {}, {}
    for c in sorted(seqs):
        for d in range(len(seqs[c]) + 1):
            nodes[tuple(seqs[c][:d])].append(c)
    for k in nodes:
        if k:
            children[k[:-1]].add(k)
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = sum(saved[x] for x in children[k]) + ((len(nodes[k]) - 1) * len(k[-1][1]) if k else 0)
    digest = {k: hashlib.sha256(",".join(str(c) for c in m if len(seqs[c]) == len(k)).encode()).hexdigest() for k, m in nodes.items()}
    return sorted((min(m), len(k), min(nodes[k[:-1]]) if k else -1, len(m), len(children[k]), leaves[k], saved[k], digest[k]) for k, m in nodes.items())


def nodes_of(found):
    return sorted(tuple(-1 if r[c] is None else r[c] for c in NODE) for r in found.collect())


def test_trie_as_by_hand(spark):
    rng, rows = random.Random(2), []
    for c in [*rng.sample(range(420), 160), 10**9 + 7]:
        for t in range(rng.choice((1, 1, 2, 3, 3, 7, 12, 40))):
            rows.append((c, rng.choice((t, t, t, None, 3)), rng.choice(("user", "assistant", None)), rng.choice(("a", "b", "hé", None, ""))))
    rows += [(None, 0, "user", "x"), (0, 0, "user", "a"), (0, 0, "user", "a"), (7, 0, "ab", "c"), (8, 0, "a", "bc"), (9, 0, "user", "long " * 50_000)]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "conv_id long, turn long, role string, text string, TEXT string, depth int")
    assert nodes_of(prefix_trie.shared_prefixes(df)) == brute_trie(rows)
    assert nodes_of(prefix_trie.shared_prefixes(df.limit(0))) == []


def test_trie_of_conversations(spark, sf_dir):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    assert nodes_of(queries.op12_prefix_trie(spark, sf_dir)) == brute_trie(rows)


def test_ends_in_several_pieces(spark):
    n = 300_000  # about two megabytes of ids
    found = prefix_trie.ends(spark.range(n).selectExpr("id % 2 AS conv_id", "3L AS depth", "id AS member")).collect()
    assert {r.conv_id: r.ends_sha256 for r in found} == {k: hashlib.sha256(",".join(map(str, range(k, n, 2))).encode()).hexdigest() for k in (0, 1)}


# --- op 13

WORD = ("word", "form", "root", "n", "n_near", "form_n")


def brute_words(rows, least, times, every, ratio):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                counts[run] += 1
    n = {w: k for w, k in counts.items() if k >= times}
    shorter, near = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            shorter[i, w[:i] + w[i + 1 :]].add(w)
            if (x := w[:i] + w[i + 1 :]) in n:
                near[w].add(x)
                near[x].add(w)
    for group in shorter.values():
        for a in group:
            near[a] |= group - {a}
    best = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: b if b is not None and n[b] >= ratio * n[w] else None for w, b in best.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else -1) for w in n)


def words_of(found):
    return sorted(tuple(("" if c == "form" else -1) if r[c] is None else r[c] for c in WORD) for r in found.collect())


@pytest.mark.parametrize(("least", "every", "ratio"), [(2, None, 2), (2, 3, 2), (1, 5, 3), (3, 31, 10)])
def test_variants_as_by_hand(spark, least, every, ratio):
    rng = random.Random(least)
    rows = [(i if i % 9 else None, " ".join("".join(rng.choice("aabÉ×") for _ in range(rng.randint(1, 5))) * rng.choice((1, 1, 1, 9)) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    rows += [(5, None), (6, ""), (7, "ab " * 50_000), (7, "ab"), (8, "x" * 30_000), (9, "x" * 29_999 + " " + "x" * 30_000), (10, "x" * 29_999), (11, "日本 ABBA Äb äb ÄB")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, Text string, n int")
    assert words_of(spelling.variants(df, least, 2, every, ratio)) == brute_words(rows, least, 2, every, ratio)
    assert words_of(spelling.variants(df.limit(0), least, 2, every, ratio)) == []


def test_variants_of_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert words_of(queries.op13_spelling(spark, sf_dir)) == brute_words(rows, 7, 2, 31, 10)


def test_words_of_one_key_are_compared_as_strings(spark, monkeypatch):
    words = ["abc", "abd", "ab", "xyz", "xyzz"]
    made = spelling.keys_of(words)
    monkeypatch.setattr(spelling, "keys_of", lambda w: (np.zeros_like(made[0]), *made[1:]))
    [batch] = list(spelling._send(1)(iter([pa.RecordBatch.from_pydict({"word": words, "n": [5, 4, 3, 2, 1]})])))
    out = spelling._group(pa.Table.from_batches([batch])).to_pylist()
    assert {r["word"]: (r["n_near"], r["form"]) for r in out} == {"abc": (2, "abd"), "abd": (2, "abc"), "ab": (2, "abc"), "xyz": (1, "xyzz"), "xyzz": (1, "xyz")}


def test_tables_of_large_rows_are_read_and_written_in_small_parts(spark):
    """Row groups of such tables are what a writer holds, and batches are what a reader holds: neither may be a whole file."""
    from pathlib import Path

    import pyarrow.parquet as pq

    from lodestone.llm.common import drop_staged, few_large_tasks, staged

    names = ("spark.sql.parquet.columnarReaderBatchSize", "parquet.block.size")
    before = [spark.conf.get(n, None) for n in names]
    with few_large_tasks(spark):
        assert int(spark.conf.get(names[0])) * (240 << 10) <= 8 << 20
        wide = spark.range(0, 200, 1, 1).selectExpr("id", "cast(array_join(transform(sequence(1, 4000), x -> sha2(string(id * 4000 + x), 256)), '') as binary) body")
        made = staged(wide, "wide")
        files = list(Path(made._lodestone_path.removeprefix("file://")).glob("*.parquet"))
        assert made.agg({"id": "sum"}).first()[0] == 19_900
    told = [pq.ParquetFile(f).metadata for f in files]
    groups = [m.row_group(i).total_byte_size for m in told for i in range(m.num_row_groups)]
    drop_staged(made)
    assert len(groups) > 1 and max(groups) < 32 << 20
    assert [spark.conf.get(n, None) for n in names] == before
