"""GraphML files, read and written by Spark (SRC15, SNK6)."""

from __future__ import annotations

from collections.abc import Iterator
from html import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DATA = "data array<struct<_key:string,_VALUE:string>>"
_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">'
#: GraphML's types of attributes, and Spark's.
TYPES = {"string": "string", "int": "int", "long": "long", "float": "float", "double": "double", "boolean": "boolean"}


def _rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).option("valueTag", "_VALUE").option("attributePrefix", "_").schema(schema).load(path)


def _value(key: str) -> Column:
    return F.get(F.filter("data", lambda d: d["_key"] == key), F.lit(0))["_VALUE"]


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of GraphML files: id, or source and target (and id, maybe null), and a typed column for each declared key.

    Parallel edges are rows of their own, so any file reads as a multigraph. Keys without a declared name go by their id; a
    value that isn't of its type is null. Only the keys, a few for a graph, reach the driver.
    """
    keys = _rows(spark, path, "key", "_id string, _for string, `_attr.name` string, `_attr.type` string").distinct().collect()

    def typed(df: DataFrame, kind: str, own: list[str]) -> DataFrame:
        out, names = [F.col(f"_{c}").alias(c) for c in own], set(own)
        for k in sorted((k for k in keys if k["_for"] in (kind, "all", None)), key=lambda k: k["_id"]):
            name = k["_attr.name"] or k["_id"]
            name = name if name not in names else f"{name}_{k['_id']}"
            names.add(name)
            value = _value(k["_id"])
            out.append(value.try_cast(TYPES.get(k["_attr.type"], "string")).alias(name))
        return df.select(*out)

    nodes = typed(_rows(spark, path, "node", f"_id string, {_DATA}"), "node", ["id"])
    edges = typed(_rows(spark, path, "edge", f"_id string, _source string, _target string, {_DATA}"), "edge", ["id", "source", "target"])
    return nodes, edges


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """nodes (id, ..) and edges (source, target, ..) as GraphML: a folder of files, each a whole document, so that tasks write on
    their own. Other columns are attributes; arrays and structs are written as JSON; nulls aren't written."""
    kinds = {"string": "string", "int": "int", "bigint": "long", "float": "float", "double": "double", "boolean": "boolean"}

    def lines(df: DataFrame, kind: str, own: list[str]) -> tuple[DataFrame, list[str]]:
        rest = [(n, t) for n, t in df.dtypes if n not in own]
        declared = [f'<key id="{kind[0]}{i}" for="{kind}" attr.name="{escape(n)}" attr.type="{kinds.get(t, "string")}"/>' for i, (n, t) in enumerate(rest)]
        text = lambda n, t: F.col(f"`{n}`").cast("string") if t in kinds else F.to_json(F.struct(F.col(f"`{n}`").alias("v")))
        safe = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
        attributes = F.concat(*[F.concat(F.lit(f' {n}="'), safe(F.col(n).cast("string")), F.lit('"')) for n in own])
        data = F.concat(F.lit(""), *[F.coalesce(F.concat(F.lit(f'<data key="{kind[0]}{i}">'), safe(text(n, t)), F.lit("</data>")), F.lit("")) for i, (n, t) in enumerate(rest)])
        return df.select(F.concat(F.lit(f"<{kind}"), attributes, F.lit(">"), data, F.lit(f"</{kind}>")).alias("value")), declared

    n, of_nodes = lines(nodes, "node", ["id"])
    e, of_edges = lines(edges, "edge", ["source", "target"])
    head = "\n".join([_HEAD, *of_nodes, *of_edges, '<graph edgedefault="directed">'])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = lambda s: pa.RecordBatch.from_pydict({"value": [s]})
        yield line(head)
        yield from batches
        yield line("</graph>\n</graphml>")

    n.unionAll(e).mapInArrow(whole, "value string").write.text(path)
