"""Connected components of a table of links, by contraction, all of it in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.llm.common import drop_table, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges (a, b: bigint); comp is the smallest node reachable.

    Each round points every node to its smallest neighbour, if that is smaller, follows pointers for four steps and
    contracts the edges to where they lead. Only nodes that are smaller than all their neighbours, and few others, are left,
    so the edges shrink by half or more and rounds grow with the logarithm of the nodes. Rounds are cut by written tables.
    The nodes that many point to are a hot join key on the probe side of equi-joins, which adaptive execution splits.
    """
    e, labels = links(edges), None
    while e.take(1):
        near = e.union(e.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        one = materialise(near.select("node", F.least("node", "m").alias("to")), "pointers")
        two = follow(one, one)
        to = materialise(follow(two, two), "pointers")
        new = links(e.join(to.toDF("a", "x"), "a").join(to.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b")))
        moved = to if labels is None else follow(labels, to, "left")
        moved = materialise(moved, "labels")
        for t in (e, one, to, *([labels] if labels is not None else [])):
            drop_table(t)
        e, labels = new, moved
    drop_table(e)
    return labels.toDF("node", "comp") if labels is not None else e.toDF("node", "comp")


def links(edges: DataFrame) -> DataFrame:
    return materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), "edges")


def follow(first: DataFrame, then: DataFrame, how: str = "inner") -> DataFrame:
    """Where (node, to) leads with one more step."""
    step = then.toDF("to", "next")
    return first.join(step, "to", how).select("node", F.coalesce("next", "to").alias("to"))
