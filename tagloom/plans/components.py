"""Connected components as joins: every node learns the smallest node it can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.runtime import checkpoint


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node that has an edge; component is the smallest node of it.

    Alternating large-star and small-star rounds: each node points at the smallest of its neighbours, which
    takes a number of rounds that grows with the logarithm of a path's length. Each round is a grouped minimum and a
    join on the node, both of which Spark splits by key; a hot node's neighbours are pre-aggregated and the
    join may be split by adaptive execution. Edges with a null end are dropped; self-edges keep their node.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    e = e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = checkpoint(e)
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: larger neighbours of u point at u's smallest
        e = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours point at the smallest of them
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        e = checkpoint(e)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"connected_components: labels still change after {max_rounds} rounds")
    return nodes.join(e, nodes.node == e.u, "left").select("node", F.coalesce("v", "node").alias("component"))
