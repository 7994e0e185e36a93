"""Rules of ingest and routing, chunk tables and route dispatch: hand-computed cases."""

from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.operators import fusion
from lodestone.sources import tables


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(("line", "made"), [("Phần I chung", "## Phần I chung"), ("ĐIỀU 12: x", "### ĐIỀU 12: x"), ("Khoản 3", "- **Khoản 3**"), ("b)  hai", "  - b)  hai"), ("Điều này", "Điều này"), ("  ", "")])
def test_legal_lines(spark, line, made):
    assert one(spark, rules.legal_line("t"), t=line) == made


def test_headings_and_ids(spark):
    assert one(spark, rules.heading("t"), t="a__b--c ") == "a b c" and one(spark, rules.heading("t"), t="_-_") == "Chunk"
    assert len(one(spark, rules.heading("t"), t="x" * 300)) == 120
    assert one(spark, rules.with_heading("t", "h"), t=" body ", h="my_name") == "### my name\n\nbody"
    assert one(spark, rules.with_heading("t", "h"), t="a\n## b", h="n") == "a\n## b" and one(spark, rules.with_heading("t", "h"), t=" ", h="n") == ""
    assert one(spark, rules.safe_id("t"), t=" Tb 55/2026! ") == "Tb_55_2026" and one(spark, rules.safe_id("t"), t="điểm") == "i_m" and one(spark, rules.safe_id("t"), t="--") == "doc"
    assert [one(spark, rules.trailing_number("t", 9), t=x) for x in ("chunk_012", "12x", "")] == [12, 9, 9]


def test_canonical_chunks(spark):
    rows = [("", "d 1", "chunk_4", "T", " ", "plain", None, "s"), (None, None, None, None, None, None, "# c", None), (None, "d", "x", None, None, "", None, None)]
    df = spark.createDataFrame(rows, "id string, doc_id string, chunk_id string, title string, text string, text_plain string, content string, source string")
    got = [tuple(r) for r in df.select(*rules.canonical_chunk(F.lit(7).cast("long"))).collect()]
    assert got[:2] == [("d_1_4", "d_1", 4, "### T\n\nplain", "s"), ("doc_7", "doc", 7, "# c", "unknown")]
    assert got[2][3] == '### d\n\n{"doc_id":"d","chunk_id":"x"}'


def test_router_rules(spark):
    faq = [(("giới thiệu",), ("summary", "program")), (("học phí",), ("hoc_phi",))]
    assert [one(spark, rules.faq_types("t", faq), t=x) for x in ("Giới thiệu HỌC PHÍ", "học phí?", "Danh sách ngành", "xin chào")] == [["summary", "program"], ["hoc_phi"], ["thong_tin_nganh"], None]
    assert [one(spark, rules.historical("t"), t=x) for x in ("So sánh", "điểm năm 2027", "tăngx", "vs", "điểm")] == [True, True, False, True, False]
    assert one(spark, rules.entity_count("t", [r"\bcntt\b|\bluật\b", r"\b[a-d][0-9]{2}\b"]), t="CNTT, cntt và Luật khối A00 a00 D01") == 4
    df = spark.createDataFrame([("Luật A00", "cntt", ["luật", "D01", "B00", "C00"])], "q string, s string, v array<string>")
    assert df.select(rules.seeds("q", "s", "v", r"\bcntt\b|\bluật\b|\b[a-d][0-9]{2}\b").alias("x")).first().x == ["luật", "a00", "cntt", "d01", "b00"]
    assert [one(spark, rules.public_status("t", "prod"), t=x) for x in ("SUCCESS", "SENSITIVE_PII_DETECTED", "TIMEOUT")] == ["SUCCESS", "SENSITIVE_PII_DETECTED", "OUT_OF_SCOPE"]
    assert one(spark, rules.public_status("t", "DEV"), t="TIMEOUT") == "TIMEOUT"


def test_chunk_tables(spark, tmp_path):
    path = str(tmp_path / "blue")
    assert [tables.bootstrap(spark, path, "doc_id long, chunk_id long"), tables.bootstrap(spark, path, "doc_id long"), tables.bootstrap(spark, path, "doc_id long, chunk_id long", force=True)] == ["created", "exists", "recreated"]
    tables.write(spark.createDataFrame([(2, 1), (0, 1)], "chunk_id long, doc_id long"), path, "append")
    assert [r.chunk_id for r in tables.chunks_of(spark.read.parquet(path), 1).collect()] == [0, 2]
    with pytest.raises(AnalysisException):
        tables.write(spark.range(1), path)
    tables.write(spark.range(3), path, "overwrite")
    assert spark.read.parquet(path).count() == 3 and not tables.exists(spark, path + "x")
    with pytest.raises(ValueError, match="merge"):
        tables.write(spark.range(1), path, "merge")


def test_dispatch(spark):
    base = spark.createDataFrame([(q, d, s) for q in (1, 2, 3) for d, s in ((10, 0.8), (11, 0.4), (12, 0.2))], "qid int, doc_id int, score double")
    ppr = spark.createDataFrame([(q, d, p) for q in (1, 2, 3) for d, p in ((12, 1.0), (20, 0.9), (21, 0.5), (22, 0.1))], "qid int, doc_id int, ppr double")
    routes = spark.createDataFrame([(1, "padded"), (2, "hybrid"), (3, "graph")], "qid int, route string")
    got = fusion.dispatch(base, ppr, routes, 3, {"hybrid": 1, "graph": 2}).orderBy("qid", "place").collect()
    assert [(r.doc_id, r.injected) for r in got if r.qid == 1] == [(10, False), (11, False), (12, False)]
    assert [(r.doc_id, r.injected, round(r.fused, 6)) for r in got if r.qid == 2] == [(10, False, 0.6), (12, False, 0.55), (20, True, 0.36)]
    assert [r.doc_id for r in got if r.qid == 3] == [10, 12, 20]


def test_the_k_best_are_those_of_a_full_sort():
    import numpy as np

    from lodestone.operators.knn import _best

    rng = np.random.default_rng(5)
    for n in (1, 5, 6, 200):
        scores, ids = rng.integers(0, 4, n) / 4, rng.permutation(n)
        assert _best(scores, ids, 5).tolist() == np.lexsort((ids, -scores))[:5].tolist()
    assert _best(np.array([np.nan, 0.5, np.nan]), np.arange(3), 2).tolist() == [1, 0]


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    import pytest

    from lodestone.session import shared_top

    def session(master, named):
        conf = SimpleNamespace(get=lambda *_: named)
        return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))

    assert shared_top(session("spark://host:7077", "hdfs://store/x/")) == "hdfs://store/x"
    with pytest.raises(ValueError):
        shared_top(session("spark://host:7077", None))
