"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by how many shingles they have. An item's sketch is its k smallest shingle hashes (a bottom-k
MinHash), with k chosen for its size partition so that a text that holds the wanted share of the item's shingles must
hold at least one of the sketch: with n shingles and a share t, at most n - ceil(t n) may be missing, so k is one more
than that for the partition's largest n. Texts, however long, are searched by their own shingle hashes, so nothing is
missed; what is found is verified by exact shingle containment.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import pick, staged
from lodestone.llm.vectors import Lookup, shingles, words

WORDS = re.compile(r"[0-9a-z\x80-\U0010FFFF]+")
SCHEMA = "doc_id long, item_id long, containment double, n_shingles int, n_found int"


def spell(text: str | None) -> list[str]:
    """Words as they are compared: lower case, runs of ASCII letters, digits and all characters beyond ASCII."""
    return WORDS.findall((text or "").lower())


def spelled_shingles(tokens: list[str], size: int) -> set[str]:
    return {" ".join(tokens[i : i + size]) for i in range(len(tokens) - size + 1)}


class Index:
    """Sketches of items: for each shingle size in use, sorted hashes and the items that each belongs to."""

    def __init__(self, items: list[tuple[int, str]], size: int, share: float) -> None:
        self.items: list[tuple[int, set[str], int]] = []
        lists: dict[int, list[tuple[int, int]]] = {}
        for item_id, text in items:
            tokens = spell(text)
            if not tokens:
                continue
            width = min(size, len(tokens))  # a shorter item is one shingle of all its words
            found = spelled_shingles(tokens, width)
            (w,) = words(pa.array([text.lower()]), lower=False, limit=1 << 60)
            hashes = np.unique(shingles(w, width)[0])
            top = (1 << len(hashes).bit_length()) - 1  # of its size partition
            for h in hashes[: top - math.ceil(share * top) + 1].tolist():
                lists.setdefault(width, []).append((h, len(self.items)))
            self.items.append((item_id, found, width))
        self.lookups = {}
        for width, pairs in lists.items():
            keys, owner = np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.int64)
            order = np.argsort(keys, kind="stable")
            unique, first = np.unique(keys[order], return_index=True)
            self.lookups[width] = Lookup(unique), np.append(first, len(keys)), owner[order]

    def candidates(self, w) -> dict[int, set[int]]:
        """text (from 0) -> items of which it holds a sketch hash."""
        out: dict[int, set[int]] = {}
        hashes = w.hashed()
        for width, (lookup, first, owner) in self.lookups.items():
            h, text = shingles(w, width, hashes)
            where, key = lookup.find(h)
            for t, k in set(zip(text[where].tolist(), key.tolist(), strict=True)):
                out.setdefault(t, set()).update(owner[first[k] : first[k + 1]].tolist())
        return out


def find_items(
    docs: DataFrame,
    items: DataFrame,
    share: float = 0.8,
    shingle: int = 5,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = 32_000_000,
) -> DataFrame:
    """doc_id, item_id, containment, n_shingles (of the item), n_found: a row for each document and item it holds.

    A document holds an item if it has at least `share` of the item's distinct word shingles. An item with fewer words
    than `shingle` is one shingle of all of them; one without words, or null, is never held; nor does a null, empty or
    too short document hold anything. Rows that repeat give rows of their own. Empty tables give no rows; further
    columns are ignored.

    The items are the query set: they are sent to the executors if their texts fit in `block_bytes`, and otherwise in
    as many blocks of that size as it takes, each searched in a pass of its own.
    """
    spark = docs.sparkSession
    rows = pick(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), "text").filter(F.col("text").isNotNull())
    asked = pick(items, item_id=item_id, text=item_text).select(F.col("item_id").cast("long"), "text").filter(F.col("text").isNotNull())
    total = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total * 5 // (block_bytes * 4))) if total > block_bytes else 1
    found = []
    for k in range(blocks):
        block = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        queries = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in block.collect()])
        part = rows.mapInArrow(_search(queries, shingle, share), SCHEMA)
        if blocks > 1:
            part = staged(part, "found")
            queries.unpersist()
        found.append(part)
    out = found[0]
    for part in found[1:]:
        out = out.unionAll(part)
    return out


def _search(queries, size: int, share: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(queries.value, size, share)
        for batch in batches:
            ids, texts, rows = batch.column(0), batch.column(1), []
            for w in words(texts):
                for t, items in sorted(index.candidates(w).items()):
                    tokens = spell(texts[w.first + t].as_py())
                    own: dict[int, set[str]] = {}
                    for k in sorted(items):
                        item, wanted, width = index.items[k]
                        if width not in own:
                            own[width] = spelled_shingles(tokens, width)
                        n = len(wanted & own[width])
                        if n >= share * len(wanted):
                            rows.append((ids[w.first + t].as_py(), item, n / len(wanted), len(wanted), n))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "containment", "n_shingles", "n_found"])

    return search


ORACLE_SQL = r"""
WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
iw AS (SELECT item_id, w, least(5, len(w)) AS width FROM i WHERE len(w) > 0),
ish AS (
  SELECT DISTINCT item_id, width, array_to_string(w[k : k + width - 1], ' ') AS s
  FROM iw, unnest(generate_series(1, len(w) - width + 1)) AS u(k)),
n AS (SELECT item_id, count(*) AS n FROM ish GROUP BY item_id),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
dsh AS (
  SELECT DISTINCT doc_id, width, array_to_string(w[k : k + width - 1], ' ') AS s
  FROM d, (SELECT DISTINCT width FROM iw), unnest(generate_series(1, len(w) - width + 1)) AS u(k))
SELECT doc_id, item_id, count(*) / any_value(n) AS containment, CAST(any_value(n) AS INTEGER) AS n_shingles, CAST(count(*) AS INTEGER) AS n_found
FROM dsh JOIN ish USING (width, s) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n)
"""
