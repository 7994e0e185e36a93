"""Caches, limits, late rows, versions, rule tables, resamples, profiles, table repair and graph files against plain versions."""

from __future__ import annotations

import random
import re
from collections import OrderedDict, deque
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import tables
from lodestone.operators import caching, matching, profiles, resample
from lodestone.plans import streams, texts
from lodestone.session import shared_path
from lodestone.sources import graphml
from lodestone.sources.versions import Conflict, JsonCache, Unhealthy, Versions, first_of
from lodestone.streaming import counters, stateful, windows

# --- caches


def brute_cache(keys, size):
    held, out = OrderedDict(), []
    for k in keys:
        hit, gone = k in held, None
        held[k] = held.pop(k, None)
        if len(held) > size:
            gone, _ = held.popitem(last=False)
        out.append((hit, gone))
    return out


@pytest.mark.parametrize(("size", "parts"), [(3, "7"), (16, "3"), (1, "5")])
def test_caches_of_users_that_span_parts(spark, size, parts):
    rng = random.Random(size)
    rows = [(i, rng.choice((1, 1, 1, 2, None)), rng.choice([*"abcdefghijklmnopqrstuv", None]), "x") for i in range(600)]
    df = spark.createDataFrame(rows, "i int, user int, k string, hit string").withColumnRenamed("hit", "other")
    had = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for user in ("user", None):
            got = {r.i: (r.hit, r.evicted) for r in caching.lru(df, "k", ["i"], user, size).collect()}
            want = {}
            for u in {r[1] for r in rows} if user else [0]:
                own = [r for r in rows if not user or r[1] == u]
                want |= dict(zip([r[0] for r in own], brute_cache([r[2] for r in own], size), strict=True))
            assert got == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", had)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert caching.lru(df.limit(0), "k", ["i"], "user").collect() == []


AT = datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame([(i, AT + timedelta(seconds=s), u) for i, s, u in rows], "event_id long, ts timestamp_ntz, user_id long").withColumn("ts", F.col("ts").cast("timestamp"))


def test_cache_state_goes_on_from_batch_to_batch(spark):
    rng = random.Random(4)
    rows = [(i, i, i % 3) for i in range(90)]
    keys = [rng.choice("abcdefg") for _ in rows]
    df = events(spark, rows).withColumn("key", F.get(F.array(*map(F.lit, keys)), F.col("event_id").cast("int")))
    state, out = shared_path(spark, "state"), shared_path(spark, "out")
    for part in windows.delivered([df.filter(F.floor(F.col("event_id") / 30) == k) for k in range(3)], "requests"):
        stateful.cached(part, 3).writeStream.option("checkpointLocation", state).trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination()
    got = {r["item"]: (r.hit, r.evicted) for r in spark.read.parquet(out).collect()}
    for u in range(3):
        own = [i for i, _, x in rows if x == u]
        assert [got[i] for i in own] == brute_cache([keys[i] for i in own], 3)


def test_limit_judges_in_order_of_time_and_drops_late_rows(spark):
    # Out of order within the delay of ten seconds; in the last batch, event 90 is far too late.
    batches = [[(1, 5, 1), (2, 2, 1), (3, 9, 1), (4, 30, 2)], [(5, 28, 1), (6, 24, 1), (7, 31, 1), (8, 33, 1)], [(90, 3, 1), (9, 100, 2)], [(10, 200, 2)]]
    state, out = shared_path(spark, "state"), shared_path(spark, "out")
    for part in windows.delivered([events(spark, b) for b in batches], "requests"):
        stateful.limited(part, 2, "10 seconds", "10 seconds").writeStream.option("checkpointLocation", state).trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination()
    got = {r["item"]: r.ok for r in spark.read.parquet(out).collect()}
    held, want = deque(), {}
    for i, s in sorted(((i, s) for b in batches for i, s, u in b if u == 1 and i != 90), key=lambda x: x[1]):
        while held and held[0] <= s - 10:
            held.popleft()
        want[i] = len(held) < 2
        if want[i]:
            held.append(s)
    assert got == want | {4: True, 9: True}


def test_final_windows_close_state_and_count_late_rows(spark):
    batches = [[(1, 0, 1), (2, 70, 1)], [(3, 10, 1), (4, 500, 1)], [(5, 20, 1), (6, 900, 1)]]
    df = [events(spark, b).withColumns({"event_type": F.lit("x"), "value": F.lit(1.0)}) for b in batches]
    state, out = shared_path(spark, "state"), shared_path(spark, "out")
    left = []
    for part in windows.delivered(df, "events"):
        q = windows.windowed(part, "60 seconds", late="30 seconds").writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).format("parquet").option("path", out).start()
        q.awaitTermination()
        left.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    rows = sorted((r.start, r.n) for r in spark.read.parquet(out).collect())
    assert [n for _, n in rows][:2] == [2, 1] and left[-1] <= 1
    found = windows.split_late(windows.delivered(df, "again"), "late", "60 seconds")
    assert {r.event_id: (r.batch, r.late) for r in found.collect()} == {1: (0, False), 2: (0, False), 3: (1, False), 4: (1, False), 5: (2, True), 6: (2, False)}


# --- versions


def test_switches_conflicts_and_pinned_readers(spark):
    log = Versions(spark, shared_path(spark, "table"))
    one, two = spark.range(5), spark.range(9)
    with pytest.raises(FileNotFoundError):
        log.read()
    assert log.write(one, lambda df: df.count() == 5) == 1
    pinned = log.read(1)
    with pytest.raises(Unhealthy):
        log.write(two, lambda df: False)
    assert log.latest() == 1 and log.read().count() == 5
    # Two writers that both start from version 1: one wins.
    assert log.write(two, parent=1) == 2
    with pytest.raises(Conflict):
        Versions(spark, log.path).write(spark.range(7), parent=1)
    assert (log.latest(), log.read().count(), pinned.count()) == (2, 9, 5)
    assert log.remove_unused() == 1 and log.read().count() == 9


def test_merges_touch_their_buckets_only_and_are_given_again(spark):
    log = Versions(spark, shared_path(spark, "table"))
    rows = spark.range(100).select((F.col("id") % 20).alias("k"), F.col("id").alias("v"))
    together = lambda old, new: old.unionByName(new).groupBy("k").agg(F.sum("v").alias("v"))
    log.write(rows.limit(0), buckets=8, keys=["k"])
    assert log.merge(rows.groupBy("k").agg(F.sum("v").alias("v")), together, 0) == 2
    before = log.entry()["parts"]
    few = rows.filter("k = 3").limit(1)
    assert log.merge(few, together, 1) == 3 and log.merge(few, together, 1) == 3 and log.merge(few, together, 0) == 3
    after = log.entry()["parts"]
    assert sum(before[b] != after[b] for b in before) == 1
    want = {r.k: r.v for r in rows.groupBy("k").agg(F.sum("v").alias("v")).collect()}
    want[3] += few.first().v
    assert {r.k: r.v for r in log.read().collect()} == want
    with pytest.raises(ValueError):
        Versions(spark, shared_path(spark, "plain")).merge(few, together, 0)


def test_fallbacks_and_json_by_modification_time(spark, tmp_path):
    (tmp_path / "b.json").write_text('[{"a": 1}, {"a": 2}]')
    path = first_of(spark, f"{tmp_path}/a.json", f"{tmp_path}/b.json")
    assert path.endswith("b.json")
    with pytest.raises(FileNotFoundError):
        first_of(spark, f"{tmp_path}/a.json")
    cache = JsonCache(spark)
    assert cache.read(path, "a int").count() == 2 and cache.read(path, "a int").count() == 2 and cache.loads == 1
    (tmp_path / "b.json").write_text('[{"a": 1}, {"a": 2}, {"a": 3}]')
    assert cache.read(path, "a int").count() == 3 and cache.loads == 2


# --- rules


@pytest.mark.parametrize(
    ("pattern", "literals"),
    [("abc", {"abc"}), ("a.c", {"a"}), ("(?:foo|barn)x", {"foo", "barn"}), ("a*", None), ("(ab)+c?", {"ab"}), (r"\d+", None), ("(x|)y+", {"y"}), ("ABC", {"abc"}), ("[ab]c", {"c"}), ("(a|b*)", None), ("a{0,2}bc", {"bc"})],
)
def test_literals_that_patterns_need(pattern, literals):
    assert matching.required(pattern) == literals


def test_rules_against_every_pattern(spark):
    rng = random.Random(1)
    rules = [(0, "abc"), (1, "A"), (2, "(?i)aB+c"), (3, r"^\s*$"), (4, "b|ca"), (5, "c$"), (6, "ſ"), (7, "(?i)s"), (8, None), (9, "é"), (10, "(?i)É")]
    rows = [(i, "".join(rng.choice("abcABſséÉ ") for _ in range(rng.randint(0, 9)))) for i in range(200)] + [(500, None), (501, "")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "id int, text string, other int")
    got = matching.fired(df, spark.createDataFrame(rules, "ord int, pattern string"), ["id"], "text")
    assert sorted((r["id"], r["ord"]) for r in got.collect()) == sorted((i, o) for i, t in rows if t is not None for o, p in rules if p is not None and re.search(p, t))
    nothing = spark.createDataFrame([], "ord int, pattern string")
    assert matching.fired(df, nothing, ["id"], "text").collect() == []


def test_containment_either_way(spark):
    rng = random.Random(2)
    make = lambda n, most: ["".join(rng.choice("abc") for _ in range(rng.randint(0, most))) for _ in range(n)]
    phrases, words = make(80, 7) + [None, "a.c"], make(60, 6) + [None, "a.c"]
    got = matching.either_way(spark.createDataFrame([(p,) for p in phrases], "phrase string"), spark.createDataFrame([(w,) for w in words], "word string"))

    def on_list(p):
        return any(p == w or len(w) >= 3 and (w in p or p in w) and not (len(w) < 4 and len(p) < 4) for w in words if w)

    assert sorted(r.phrase for r in got.collect()) == sorted({p for p in phrases if p and on_list(p)})


# --- resamples


def test_draws_are_a_poisson_sample_and_equal_in_sql(spark):
    x = resample.draws(np.arange(5000), 40, 42)
    w = sum((x > int(s * (resample.MASK + 1))).astype(int) for s in resample.SHARES)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06 and abs(np.corrcoef(w[:-1, 0], w[1:, 0])[0, 1]) < 0.06
    import duckdb

    got = duckdb.sql(f"SELECT {resample.draws_sql('i', 'r', 42)} FROM range(50) AS a(i), range(40) AS b(r) ORDER BY i, r").fetchall()
    assert [g[0] for g in got] == x[:50].ravel().tolist()


def test_bootstrap_of_few_rows(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None)], "id long, v double")
    r = resample.bootstrap(df, "v", "id", 50).first()
    assert (r.n, r.mean, r.low, r.high) == (1, 2.0, None, None)
    r = resample.bootstrap(spark.range(200).select("id", F.col("id").cast("double").alias("v")), "v", "id", 400).first()
    assert r.low < r.mean == 99.5 < r.high and 12 < r.high - r.low < 20


# --- chunks


def brute_windows(text, p):
    """The rules one by one, without shared code."""
    n = lambda s: len(s.split())
    if n(text) <= p.size:
        return [text]
    cut = [[]]
    for line in text.splitlines():
        line = line.strip()
        if not line:
            if cut[-1] and cut[-1][-1] != "":
                cut[-1].append("")
        elif cut[-1] and profiles.BLOCK.match(line):
            cut.append([line])
        else:
            cut[-1].append(line)
    parts, joint = ["\n".join(c).strip() for c in cut if c], "\n\n"
    if len(parts) <= 1:
        for s in p.separators:
            if s in text:
                parts, joint = text.split(s), s
                break
        else:
            parts = [text]
    out, now, size = [], [], 0
    for part in parts:
        part = part.strip()
        if part and size + n(part) > p.size:
            if now and n(joint.join(now)) >= p.least:
                out.append(joint.join(now).strip())
            whole = "".join(now)
            tail = whole if n(whole) <= p.overlap else " ".join(whole.split()[-p.overlap :])
            now = [tail, part] if tail and p.overlap else [part]
            size = n(joint.join(now))
        elif part:
            now.append(part)
            size += n(part)
    if now and n(joint.join(now)) >= p.least:
        out.append(joint.join(now).strip())
    return out


@given(st.lists(st.sampled_from(["a", "b c", "Điều 1. x", "# h", "\n", "\n\n", ". ", " ", "khoản 2 y", "z " * 9]), max_size=60), st.integers(4, 14), st.integers(0, 5), st.integers(1, 6))
@settings(max_examples=200, deadline=None)
def test_windows_follow_the_rules(words, size, overlap, least):
    p = profiles.Profile(size, overlap, least, ("\n\n", "\n", ". ", " "))
    text = "".join(words)
    assert profiles.windows(text, p) == brute_windows(text, p)


def test_chunk_rows_of_documents(spark, sf_dir):
    docs = texts.documents_with_metadata(spark, sf_dir).collect()
    rows = sorted(profiles.chunked(spark.createDataFrame(docs, "doc_id long, text string, text_plain string, summary string, metadata map<string,string>")).collect(), key=lambda r: (int(r.doc_id), r.chunk_id))
    at = 0
    for d in sorted(docs, key=lambda d: d.doc_id):
        m = d.metadata
        kind = "faq" if "faq_type" in m else "policy" if "policy" in m.get("info_type", "") or re.search(profiles.POLICY, d.text, re.IGNORECASE) else "auto"
        text = (d.summary or d.text) if kind == "faq" else d.text
        want = brute_windows(text, profiles.PROFILES[kind])
        own = rows[at : at + len(want)]
        at += len(want)
        assert [(r.doc_id, r.chunk_id, r.text, r.profile) for r in own] == [(str(d.doc_id), i, t, kind) for i, t in enumerate(want)]
        for i, r in enumerate(own):
            assert r.id == f"{d.doc_id}_chunk_{i}" and r.prev_chunk_id == (own[i - 1].id if i else "") and r.next_chunk_id == (own[i + 1].id if i + 1 < len(own) else "")
            assert r.breadcrumbs == [m["source"], *([x[0]] if (x := profiles.SECTION.search(r.text)) else [])]
            assert all(len(t) > 2 and t == t.lower() for t in r.sparse_terms)
    assert at == len(rows)


def test_sections_close_those_below_them():
    assert profiles.open_sections("CHƯƠNG I Chung\nĐiều 1. a\nKhoản 2. b", []) == ["CHƯƠNG I", "Điều 1", "Khoản 2"]
    assert profiles.open_sections("text\nĐiều 2: c", ["CHƯƠNG I", "Điều 1", "Khoản 2"]) == ["CHƯƠNG I", "Điều 2"]
    assert profiles.open_sections("# other\na) x", ["CHƯƠNG I"]) == ["CHƯƠNG I"]


# --- tables in answers


def brute_repair(text):
    out, block = [], []
    cells = lambda s: [c.strip() for c in s.strip().removeprefix("|").removesuffix("|").split("|")]

    def close():
        if not block:
            return
        wide = [cells(b) for b in block]
        n = len(wide[0])
        if len(block) > 1 and "-" in block[1] and not set(block[1].strip()) - set(" :-|"):
            if len({len(w) for w in wide}) == 1:
                out.extend(block)
            else:
                out.append("| " + " | ".join(wide[0]) + " |")
                out.append("|" + "|".join(["---"] * n) + "|")
                out.extend("| " + " | ".join((w + [""] * n)[:n]) + " |" for w in wide[2:])
        else:
            out.extend(["- " + ": ".join(c for c in w if c) for w in wide if any(w)] or block)
        block.clear()

    for line in text.split("\n"):
        if line.strip().startswith("|"):
            block.append(line)
        else:
            close()
            out.append(line)
    close()
    return "\n".join(out)


def test_tables_are_repaired_once(spark):
    rng = random.Random(3)
    lines = ["| a | b |", "|a|b|c|", "|---|---|", " |:-:| --|  ", "| x |", "plain", "", "||", "|", "| a | | b |", "a | b", "|--a|"]
    cases = ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 8))) for _ in range(150)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*cases, None])], "i int, t string").withColumn("r", tables.repaired("t")).withColumn("again", tables.repaired("r"))
    for r in df.collect():
        assert r.r == (None if r.t is None else brute_repair(r.t)) and r.again == r.r, r.t


def test_repaired_answers(spark, sf_dir):
    rows = texts.table_repair(spark, sf_dir).collect()
    assert rows and all(r.repaired == brute_repair(r.answer) for r in rows) and any(r.repaired != r.answer for r in rows)


# --- graph files, counters


def test_graphs_of_other_writers(spark, tmp_path):
    (tmp_path / "g.graphml").write_text("""<?xml version="1.0"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">
<key id="d0" for="node" attr.name="size" attr.type="int"/><key id="d1" for="edge" attr.name="weight" attr.type="double"/><key id="d2" for="node" attr.name="name" attr.type="string"/>
<graph edgedefault="directed"><node id="a"><data key="d0">3</data><data key="d2">x &amp; "y"</data></node><node id="b"><data key="d0">no</data></node>
<edge source="a" target="b"><data key="d1">0.5</data></edge><edge source="a" target="b" id="1"><data key="d1">2</data></edge></graph></graphml>""")
    n, e = graphml.read_graph(spark, str(tmp_path))
    assert sorted((r["id"], r["size"], r["name"]) for r in n.collect()) == [("a", 3, 'x & "y"'), ("b", None, None)]
    assert sorted((r.source, r.target, r.weight) for r in e.collect()) == [("a", "b", 0.5), ("a", "b", 2.0)]
    graphml.write_graph(n, e.drop("id"), f"{tmp_path}/out")
    again, links = graphml.read_graph(spark, f"{tmp_path}/out")
    assert sorted(map(tuple, again.select("id", "size", "name").collect())) == sorted(map(tuple, n.select("id", "size", "name").collect())) and links.count() == 2


def test_counters_come_with_the_action(spark):
    df = spark.range(10).select("id", F.when(F.col("id") > 1, F.col("id") * 1.0).alias("ms"))
    told, seen = counters.observed(df, "ms", F.col("id") % 4 == 0)
    assert told.count() == 10
    assert seen.get == {"requests": 10, "failures": 3, "measured": 8, "total": 44.0} and counters.mean(seen.get) == 5.5
    assert counters.mean({"measured": 0, "total": 0.0}) is None and streams.request_counters is not None
