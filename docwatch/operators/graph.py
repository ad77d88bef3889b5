"""Connected components of a large graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docwatch.operators.checkpoints import checkpointed, renewed


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(u, v): root is the smallest node that it is connected to, itself included.

    Every round hangs a node's larger neighbours, then its smaller ones and itself, on the smallest of them, so that paths
    shrink to stars. Minima are aggregated before they shuffle; the join that hands them back can split a hub."""
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    now = renewed(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    turned = lambda df: df.union(df.select("v", "u"))
    lowest = lambda df: checkpointed(df.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    digest = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = digest(now)
    for _ in range(rounds):
        both = turned(now)
        large = both.join(lowest(both), "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = checkpointed(large.distinct())
        low = lowest(large)
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = renewed(small.where("u <> v").distinct())
        before, seen = seen, digest(now)
        if before == seen:
            return nodes.join(now, nodes["node"] == now["u"], "left").select("node", F.coalesce("v", "node").alias("root"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
