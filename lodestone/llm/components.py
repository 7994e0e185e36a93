"""Connected components of an edge table by pointer jumping and contraction; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import drop_staged, staged


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root for every node that an edge (a long, b long) touches; nodes of a component share the root.

    Each round every node points to its smallest neighbour (or itself), pointers are followed twice, and edges shrink
    to their ends' targets until none is left. The hottest node costs one row a task, since minima are pre-aggregated.
    """
    live = staged(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").distinct(), "edges")
    labels = None
    for _ in range(rounds):
        both = live.select("a", "b").unionAll(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("to")), "point")
        jump = staged(_follow(point, point), "jump")
        drop_staged(point)
        if labels is None:
            new_labels = jump.select("node", F.col("to").alias("root"))
        else:
            moved = jump.select(F.col("node").alias("root"), "to")
            new_labels = labels.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        new_labels = staged(new_labels, "labels")
        left = jump.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        right = jump.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        shrunk = live.join(left, "a").join(right, "b").filter("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        new_live = staged(shrunk, "edges")
        drop_staged(live, jump, *([labels] if labels is not None else []))
        live, labels = new_live, new_labels
        if live.isEmpty():
            drop_staged(live)
            return labels
    raise RuntimeError("components did not converge")


def _follow(pointers: DataFrame, targets: DataFrame) -> DataFrame:
    """Each node's pointer, followed once more."""
    onward = targets.select(F.col("node").alias("to"), F.col("to").alias("next"))
    return pointers.join(onward, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
