"""Hand-computed cases and metamorphic checks of the operators."""

from __future__ import annotations

import time
import unicodedata

import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import bm25, chunking, filters, fusion, graph, knn, metrics, profiles
from lodestone.sources import files, html
from lodestone.streaming import windows


def one(df, column):
    return df.collect()[0][column]


def test_precision_recall_and_reciprocal_rank(spark):
    ret = spark.createDataFrame([(1, x, i) for i, x in enumerate("AXYBZ", 1)], "qid int, item string, rank int")
    r = metrics.per_query(ret, spark.createDataFrame([(1, "A"), (1, "B")], "qid int, item string")).first()
    assert (r.r_at_1, r.r_at_3, r.r_at_5) == (0.5, 0.5, 1.0) and r.p_at_3 == pytest.approx(1 / 3)
    only_b = metrics.per_query(ret, spark.createDataFrame([(1, "B"), (2, "Q")], "qid int, item string")).orderBy("qid").collect()
    assert [x.rr for x in only_b] == [0.25, 0.0]


def test_percentiles(spark):
    v = spark.createDataFrame([(float(x),) for x in range(1, 6)], "v double")
    assert one(v.agg(metrics.percentile("v", 0.5).alias("p")), "p") == 3.0
    assert one(v.filter("v > 9").agg(metrics.percentile("v", 0.5).alias("p")), "p") == 0.0
    t = spark.createDataFrame([(x,) for x in (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.95, 1.0)], "v double")
    places = {"m": lambda n: F.floor((n - 1) / 2), "p": lambda n: F.floor((n - 1) * 0.95)}
    both = t.withColumn("g", F.lit("x")).unionAll(t.limit(0).withColumn("g", F.lit("y"))).unionAll(spark.createDataFrame([(None, "z"), (3.0, None), (3.0, None)], "v double, g string"))
    assert {r.g: (r.m, r.p) for r in metrics.order_stats(both, "g", "v", places).collect()} == {"x": (0.5, 0.95), None: (3.0, 3.0)}


@pytest.mark.parametrize(("s", "n", "low", "verdict"), [(7, 7, 0.646, "informational"), (30, 30, 0.886, "pass"), (29, 30, 0.833, "fail"), (0, 30, 0.0, "fail"), (15, 20, 0.531, "informational"), (0, 0, 0.0, "informational")])
def test_wilson(spark, s, n, low, verdict):
    df = spark.createDataFrame([(float(s), float(n))], "s double, n double")
    r = df.select(metrics.wilson_low(F.col("s"), F.col("n")).alias("low"), metrics.verdict(F.col("s"), F.col("n")).alias("v")).first()
    assert r.low == pytest.approx(low, abs=2e-3) and r.v == verdict
    assert r.low == pytest.approx(metrics.wilson_low_value(s, n), abs=1e-12)


def test_lost_in_middle(spark):
    for n, want in ((1, [1]), (2, [1, 2]), (5, [1, 3, 5, 4, 2])):
        df = spark.createDataFrame([(1, i) for i in range(1, n + 1)], "qid int, rank int")
        assert [r["rank"] for r in fusion.lost_in_middle(df).orderBy("place").collect()] == want


def test_rrf_is_symmetric(spark):
    a = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "qid int, doc_id int, rank int")
    b = spark.createDataFrame([(1, 8, 1), (1, 9, 2)], "qid int, doc_id int, rank int")
    x = {r.doc_id: r.score for r in fusion.rrf([(a, 0.6), (b, 0.4)]).collect()}
    y = {r.doc_id: r.score for r in fusion.rrf([(b, 0.4), (a, 0.6)]).collect()}
    assert x == pytest.approx(y) and x[8] == pytest.approx(0.6 / 62 + 0.4 / 61)


def test_cutoff(spark):
    df = spark.createDataFrame([(1, i, s, i) for i, s in ((1, 1.0), (2, 0.5), (3, 0.2), (4, 0.1))], "qid int, doc_id int, score double, rank int")
    ids = lambda d: [r.doc_id for r in d.orderBy("place").collect()]
    assert ids(fusion.cutoff(df, 0.3, 2, F.lit(False))) == [1, 2]
    assert ids(fusion.cutoff(df, 0.3, 2, F.col("doc_id") == 4)) == [1, 2, 4]
    assert ids(fusion.cutoff(df, 0.9, 3, F.lit(False))) == [1, 2, 3]
    assert ids(fusion.cutoff(df, 0.0, 1, F.lit(False))) == [1, 2, 3, 4]
    kept = [len(ids(fusion.cutoff(df, r, 0, F.lit(False)))) for r in (0.1, 0.3, 0.6, 1.0)]
    assert kept == sorted(kept, reverse=True)


def test_confidence(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (2, 1, 0.9), (2, 2, 0.5), *[(3, i, 1.0 / i) for i in range(1, 5)]], "qid int, rank int, score double")
    got = {r.qid: r.confidence for r in fusion.confidence_top3(df).collect()}
    assert got == pytest.approx({1: 0.9, 2: 0.78, 3: 0.5 + 0.15 + 0.2 / 3})


def test_fusion_without_graph_scores(spark):
    base = spark.createDataFrame([(1, "a", 0.7)], "qid int, doc_id string, score double")
    none = spark.createDataFrame([], "qid int, doc_id string, ppr double")
    assert one(fusion.graph_fused(base, none), "fused") == 0.7


def test_bm25_finds_the_document(spark):
    docs = spark.createDataFrame([(1, "điểm chuẩn ngành"), (2, "học phí ngành cntt"), (3, "ký túc xá")], "doc_id int, text string").select("doc_id", bm25.tokens("text").alias("words"))
    asked = spark.createDataFrame([(1, "học phí")], "qid int, t string").select("qid", bm25.tokens("t").alias("qwords"))
    r = bm25.search(docs, asked, 3).collect()
    assert [x.doc_id for x in r] == [2]
    n, df, tf, dl, avg = 3, 1, 1, 4, 10 / 3
    term = math.log(n - df + 0.5) - math.log(df + 0.5)
    assert r[0].score == pytest.approx(2 * term * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg)))


def test_knn_batch_equals_single(spark):
    v = spark.createDataFrame([(i, [float(i % 5), float(i % 3), 1.0]) for i in range(30)] + [(99, None), (98, [1.0])], "vec_id long, embedding array<float>")
    q = v.filter("vec_id < 3").selectExpr("vec_id qid", "embedding qvec")
    batch = {(r.qid, r["rank"]): r.vec_id for r in knn.nearest(q, v, 4).collect()}
    for i in range(3):
        for r in knn.nearest(q.filter(f"qid = {i}"), v, 4).collect():
            assert batch[i, r["rank"]] == r.vec_id
    assert len(batch) == 12


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_many_queries_go_over_a_grid(spark, monkeypatch, metric):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 11), 1.0][: 3 - i % 2]) for i in range(120)] + [(999, None), (998, [])], "vec_id long, embedding array<float>")
    q = v.filter("vec_id % 3 = 0 or vec_id > 900").selectExpr("vec_id qid", "embedding qvec")
    told = lambda: {(r.qid, r["rank"]): (r.vec_id, round(r.score, 9)) for r in knn.nearest(q, v, 4, metric).collect()}
    sent = told()
    monkeypatch.setattr(knn, "BLOCK", 5)
    monkeypatch.setattr(knn, "CELL", 17)
    assert told() == sent and len(sent) == 160


def test_bm25_reads_the_corpus_once_and_many_words_join(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", bm25.tokens("text").alias("words"))
    asked = spark.createDataFrame([(1, "the and of nothingsuch the"), (2, ""), (3, None)], "qid long, t string").select("qid", bm25.tokens("t").alias("qwords"))
    told = lambda df: {(r.qid, r.doc_id): (r["rank"], round(r.score, 9)) for r in df.collect()}
    once = bm25.search(docs, asked, 5)
    assert "documents.parquet" not in once._jdf.queryExecution().executedPlan().toString()
    few = told(once)
    monkeypatch.setattr(bm25, "WORDS", 1)
    assert told(bm25.search(docs, asked, 5)) == few and len(few) == 5
    assert bm25.search(docs.limit(0), asked, 5).collect() == []


def test_bm25_keeps_no_pairs_of_queries_and_documents(spark, monkeypatch):
    """Each document has a word of each query: what is kept, and shuffled, is k rows of a query and task, in one block or many."""
    from pyspark.sql import functions as F

    docs = spark.range(600, numPartitions=3).select(F.col("id").alias("doc_id"), F.array(F.lit("a"), F.concat(F.lit("b"), F.col("id") % 7), F.concat(F.lit("c"), F.col("id") % 50), F.lit("a")).alias("words"))
    docs = docs.unionByName(spark.createDataFrame([(None, ["b1", "c1"]), (1000, None), (1001, []), (1002, [None, "a"])], "doc_id long, words array<string>"))
    asked = spark.range(40).select(F.col("id").alias("qid"), F.array(F.lit("a"), F.concat(F.lit("b"), F.col("id") % 7), F.concat(F.lit("c"), F.col("id"))).alias("qwords"))
    paths, path = [], bm25.passing_path
    monkeypatch.setattr(bm25, "passing_path", lambda s, name: paths.append(path(s, name)) or paths[-1])
    told = lambda: sorted((r.qid, r["rank"], -1 if r.doc_id is None else r.doc_id, round(r.score, 9)) for r in bm25.search(docs, asked, 3).collect())
    one = told()
    kept = [spark.read.parquet(p) for p in paths if p.rsplit("/", 1)[1].startswith("bm25-") and not p.rsplit("/", 1)[1].startswith("bm25-words")]
    assert sum(t.count() for t in kept) <= 40 * 3 * docs.rdd.getNumPartitions()
    tf = [(r.doc_id, [w for w in r.words or [] if w]) for r in docs.collect()]
    n, avgdl = len(tf), sum(len(w) for _, w in tf) / len(tf)
    df = {t: sum(t in w for _, w in tf) for t in {t for _, w in tf for t in w}}
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: x if x >= 0 else 0.25 * mean for t, x in raw.items()}
    want = []
    for r in asked.collect():
        each = [(sum(idf[t] * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avgdl)) for t in r.qwords), -1 if i is None else i) for i, w in tf]
        best = sorted((-round(s, 9), i) for s, i in each if s > 0)[:3]
        want += [(r.qid, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert [x[:3] for x in one] == [x[:3] for x in sorted(want)] and [x[3] for x in one] == pytest.approx([x[3] for x in sorted(want)])
    monkeypatch.setattr(bm25, "WORDS", 25)
    assert told() == one
    batch = pa.RecordBatch.from_pydict({"words": [["a"] * n for n in (0, 3, 0, 900, 2, 2, 0)]})
    monkeypatch.setattr(bm25, "PORTION", 4)
    assert [[len(w) for w in b.column(0).to_pylist()] for b in bm25.portions(iter([batch.slice(1)]))] == [[3, 0], [900], [2, 2, 0]]


def test_grounded_answers_keep_no_pairs(spark, monkeypatch):
    """Each source shares words with each answer: what is kept is a row of an answer and task, in one block or many."""
    docs = spark.range(300, numPartitions=3).select(F.col("id").alias("doc_id"), F.array(F.lit("a"), F.concat(F.lit("b"), F.col("id") % 7), F.concat(F.lit("c"), F.col("id") % 50), F.lit("a")).alias("s"))
    docs = docs.unionByName(spark.createDataFrame([(None, ["b1", "c1", "a"]), (1000, None), (1001, []), (1002, ["zz"])], "doc_id long, s array<string>"))
    asked = spark.createDataFrame([(i, ["a", f"b{i % 7}", f"c{i}"]) for i in range(30)] + [(98, ["none"]), (99, []), (97, ["zz", "yy"])], "item_id long, a array<string>")
    paths, path = [], metrics.passing_path
    monkeypatch.setattr(metrics, "passing_path", lambda s, name: paths.append(path(s, name)) or paths[-1])
    told = lambda: sorted((r.item_id, r.doc_id, round(r.grounded, 9)) for r in metrics.best_grounded(asked, docs).collect())
    got, want = told(), []
    assert spark.read.parquet(paths[0]).count() <= 33 * docs.rdd.getNumPartitions()
    held = [(math.inf if r.doc_id is None else r.doc_id, set(r.s or [])) for r in docs.collect()]
    for item, words in asked.collect():
        if words and (best := max((len(set(words) & s) / len(words), -i) for i, s in held))[0] > 0:
            want.append((item, int(-best[1]), round(best[0], 9)))
    assert got == sorted(want) and len(got) == 31
    monkeypatch.setattr(bm25, "WORDS", 20)
    assert told() == got


def test_chunks_are_given_on_before_they_are_many(spark, monkeypatch):
    """A task holds few rows and chunks as Python objects, whatever the batch."""
    kind, taken = type(spark.range(1)), []
    write = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, run, *more: taken.append(run) or write(self, run, *more))
    profiles.chunked(spark.createDataFrame([], "doc_id long, text string, text_plain string, summary string, metadata map<string,string>"))
    rows = [{"doc_id": str(i), "text": f"w{i} " * 1000, "text_plain": None, "summary": None, "source": "s", "profile": "auto"} for i in range(900)]
    out = list(taken[0](iter([pa.RecordBatch.from_pylist(rows[:700]), pa.RecordBatch.from_pylist(rows[700:])])))
    sizes = [sum(map(len, b.column("text").to_pylist())) for b in out]
    assert len(sizes) > 3 and max(sizes) < profiles.HELD + 10_000
    assert list(dict.fromkeys(i for b in out for i in b.column("doc_id").to_pylist())) == [r["doc_id"] for r in rows]


def test_scope_is_told_once_a_text(spark):
    """Texts and phrases are folded in one step of one job, and the decision reads what it wrote."""
    from lodestone.functions import scope

    rows = [(1, "Ngành Kinh Tế điểm chuẩn"), (2, "học phí ngành Khoa học dữ liệu"), (3, "học toán"), (4, None), (5, "")]
    asked = spark.createDataFrame(rows, "id int, text string")
    offered = spark.createDataFrame([("khoa hoc du lieu",)], "word string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(scope.named(asked)).count("EvalPython") == 1
    out = scope.decided(asked, offered, ("kinh te",), ("hoc phi",))
    assert "EvalPython" not in plan(out)
    assert sorted((r.id, r.phrase, r.out_of_scope) for r in out.collect()) == [(1, "Kinh Tế", True), (2, "Khoa học dữ liệu", False), (3, None, False), (4, None, False), (5, None, False)]


def test_pagerank(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "node_id string")
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 3.0), ("b", "a", 1.0)], "head string, tail string, weight double")
    seed = spark.createDataFrame([("a",)], "node_id string")
    r = {x.node_id: x.score for x in graph.pagerank(nodes, edges, seed).collect()}
    assert sum(r.values()) == pytest.approx(1) and r["d"] == pytest.approx(0, abs=1e-4) and r["a"] == max(r.values())
    assert graph.pagerank(nodes, edges, spark.createDataFrame([("z",)], "node_id string")).isEmpty()
    assert graph.pagerank(nodes, edges, seed, rounds=1, tolerance=1e-12).isEmpty()


def test_graph_statistics(spark):
    n = spark.createDataFrame([("a",), ("b",)], "node_id string")
    e = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "a")], "head string, tail string")
    r = graph.statistics(n, e).first()
    assert (r.nodes, r.edges, r.avg_degree, r.max_degree) == (2, 3, 3.0, 4)


@pytest.mark.parametrize(("text", "want"), [("Học phí năm nay là?", "current"), ("điểm năm ngoái", "historical"), ("so sánh các ngành", "cross_year"), ("điểm 2024", "historical"), ("điểm 2027", "current"), ("xin chào", "ambiguous")])
def test_temporal_intent(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert one(df.select(T.temporal_intent(F.col("t"), 2026).alias("i")), "i") == want


def test_relative_years(spark):
    df = spark.createDataFrame([("Học phí năm nay là?",), ("năm nay 2025",)], "t string")
    assert [r.t for r in df.select(T.with_years(F.col("t"), 2026).alias("t")).collect()] == ["Học phí năm 2026 là?", "năm nay 2025"]


def test_year_clause():
    assert T.year_clause("other", 2026) is None
    with pytest.raises(ValueError):
        T.year_clause("current", 2019)


def test_scalars(spark):
    df = spark.createDataFrame([("  Ngành A-1! ", "12", "Điểm 17,25đ"), ("!!", "x", "-3")], "a string, b string, c string")
    r = df.select(T.slug("a").alias("s"), T.whole_number(F.col("b")).alias("n"), T.decimal_comma(F.col("c")).alias("d")).collect()
    assert [tuple(x) for x in r] == [("ng_nh_a_1", 12, 17.25), ("doc", None, None)]


def test_filters(spark):
    df = spark.createDataFrame([(1, "x", {"k": "v"}), (2, None, {"a": "x"}), (3, "y", None)], "id int, a string, meta map<string,string>")
    assert {r.id for r in filters.metadata_filter(df, {"a": "x"}, "meta").collect()} == {1, 2}
    assert {r.id for r in filters.metadata_filter(df, {"a": "zz", "or_conditions": [{"a": "y"}]}, "meta").collect()} == {3}
    assert filters.with_fallback(df, F.col("id") == 9).count() == 3
    assert filters.with_fallback(df, F.col("id") == 1).count() == 1


def test_iou_and_streaks(spark):
    a = spark.createDataFrame([(1, 0, 10), (1, 5, 12)], "k int, start long, end_ long")
    b = spark.createDataFrame([(1, 6, 16)], "k int, start long, end_ long")
    assert one(chunking.iou(a, b, "k"), "iou") == pytest.approx(6 / 16)
    s = spark.createDataFrame([(1, i, v) for i, v in enumerate([0.4, 0.3, 0.9, 0.1, 0.1, 0.1, 0.1])], "k int, i int, v double")
    r = chunking.streaks(s, F.col("v") < 0.5, ["i"], "k").orderBy("i").collect()
    assert [x.streak for x in r] == [1, 2, 0, 1, 2, 3, 4] and [x.escalate for x in r] == [False] * 5 + [True] * 2


def test_chunks():
    p = profiles.Profile(10, 2, 3, (". ", " "))
    assert profiles.windows("một hai", p) == ["một hai"] and profiles.windows("a b c d", p) == ["a b c d"]
    parts = profiles.windows(". ".join(f"w{i} x y z" for i in range(8)), p)
    assert len(parts) > 2 and all(3 <= len(x.split()) <= 14 for x in parts)
    # The tail joins parts by nothing; sizes are measured anew after an overflow.
    assert parts[0] == "w0 x y z. w1 x y z" and parts[1] == "y z. w2 x y z. w3 x y z"
    legal = profiles.windows("Điều 1 " + "a " * 8 + "\n\n\nĐiều 2 " + "b " * 8, p)
    assert legal[0].startswith("Điều 1") and legal[1].startswith("a a\n\nĐiều 2")
    assert profiles.windows("x" + " y" * 30, profiles.Profile(10, 0, 3, ("|",))) == ["x" + " y" * 30]
    assert profiles.windows("a b\n\n" + "y " * 30, profiles.Profile(10, 0, 3, ("\n\n",))) == [("y " * 30).strip()]


@pytest.mark.parametrize("text", ["", "x" * 95, "một câu. hai câu, và ba câu nữa thì sao? " * 4])
def test_pieces_join_to_the_text(text):
    cut = chunking.pieces(text)
    assert "".join(cut) == text and all(len(p) <= 40 for p in cut)


def test_html(spark):
    page = "<script>1</script><table><tr><th>Mã</th></tr><tr><td> 7480201 </td><td>17,5</td></tr></table><p>Xin  chào</p>"
    df = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    assert [r.cells for r in html.table_rows(df).collect()] == [["7480201", "17,5"]]
    assert {r.page_id: r.text for r in html.visible_text(df).collect()} == {1: "Mã 7480201 17,5 Xin chào", 2: ""}


def test_records(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":"1","text":"xin"}\n\nnot json\n"chỉ chữ"\n[1]\n{"chunk_id":4,"text":""}\n', encoding="utf-8")
    (tmp_path / "b_enhanced.jsonl").write_text('{"id":"9","text":"no"}\n')
    r = files.read_records(spark, str(tmp_path), but="enhanced").collect()
    assert sorted((x.id or "", x.text) for x in r) == [("", ""), ("1", "xin"), ("a", "chỉ chữ")]
    assert files.read_chunks(spark, str(tmp_path), but="enhanced").count() == 2
    assert files.manifest(spark, str(tmp_path)).count() == 2


def test_rate_limit():
    ok, held = windows.accepted([0, 1, 2, 59, 60.5, 61.5], [], 2, 60.0)
    assert ok == [True, True, False, False, True, True] and held == [60.5, 61.5]


def test_latest_and_first(spark):
    df = spark.createDataFrame([("a", 2024, 1.0), ("a", 2025, 2.0), ("b", 2023, 3.0)], "k string, y int, v double")
    assert {r.k: r.v for r in filters.latest(df, ["k"], "y").collect()} == {"a": 2.0, "b": 3.0}
    tied = df.unionAll(spark.createDataFrame([("a", 2025, 0.5), ("a", None, 9.0)], df.schema))
    assert {r.k: r.v for r in filters.latest(tied, ["k"], "y").collect()} == {"a": 0.5, "b": 3.0}
    assert {r.k: r.v for r in filters.first_wins(df, ["k"], ["y"]).collect()} == {"a": 1.0, "b": 3.0}


def test_vietnamese_rules(spark):
    df = spark.createDataFrame([("Điểm chuẩn NGÀNH  tuyển sinh?",), ("đối chiếu học phí",), ("0912345678901234567",), ("gọi 0912 345 678 nhé",), (None,)], "t string")
    r = df.select(T.fold("t").alias("fold"), T.unaccent("t").alias("flat"), T.normal_answer("t").alias("answer"), T.sparse_terms(F.col("t")).alias("terms"), T.temporal_intent(F.col("t"), 2026).alias("intent"), T.has_pii(F.col("t")).alias("pii")).collect()
    assert r[0].fold == "điem chuan nganh  tuyen sinh?" and r[0].flat == "diểm chuẩn nganh  tuyển sinh?"
    assert r[0].answer == unicodedata.normalize("NFKD", "điểm chuẩn ngành tuyển sinh") and r[0].terms == ["điểm", "chuẩn", "ngành", "tuyển", "sinh"]
    assert (r[1].intent, r[0].intent) == ("cross_year", "ambiguous") and [x.pii for x in r] == [False, False, False, True, None]
    assert r[4].fold is None and T.sparse_terms(F.lit("a"), most=50) is not None


def test_cells_keep_their_words_apart(spark):
    pages = spark.createDataFrame([(1, "<table><tr><td>15<br>16</td><td>a<b>b</b></td><td>x</td></tr><tr><th>no digit</th></tr></table>"), (2, None)], "page_id long, html string")
    assert [r.cells for r in html.table_rows(pages).collect()] == [["15 16", "a b", "x"]]


def test_boilerplate_of_a_long_text(spark):
    text = "\n".join(["Chương 1", "page footer", *(f"line {i % 9000}" for i in range(20_000))] * 1 + ["page footer"] * 5 + ["Chương 1"] * 4)
    df = spark.createDataFrame([(1, text), (2, "a\nb"), (3, None), (4, "")], "doc_id int, text string")
    began = time.monotonic()
    got = {r.doc_id: r.text for r in chunking.without_boilerplate(df).collect()}
    assert time.monotonic() - began < 30
    often = {f"line {i}" for i in range(2000)} | {"page footer"}
    kept = [x for x in text.split("\n") if x not in often]
    assert got == {1: "\n".join(("\n" if i else "") + "## " + x if x == "Chương 1" else x for i, x in enumerate(kept)), 2: "a\nb", 3: None, 4: ""}
