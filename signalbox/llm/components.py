"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbox.llm.storage import stored

ROUNDS = 60


def _smaller_first(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Connect every node's neighbours (with ``both``, its larger ones only) to its smallest neighbour or itself."""
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    linked = near.join(least, "u")
    if both:
        return _smaller_first(linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
    return _smaller_first(linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of (u, v) edges reaches.

    Every round stores the edges; the number of edges never grows, and rounds end when they
    form stars around the smallest nodes.  No group is collected.
    """
    current = stored(_smaller_first(edges), "edges")
    mark = None
    for _ in range(ROUNDS):
        current = stored(_star(_star(current, True), False), "edges")
        now = tuple(current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())
        if now == mark:
            # every edge leads to a label: a node and its label, and the label itself
            return current.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
                current.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            )
        mark = now
    raise RuntimeError(f"components still change after {ROUNDS} rounds")
