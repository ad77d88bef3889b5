"""What the corpus operators share: lineage cuts, word rules, connected components."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docwatch.operators.checkpoints import renewed

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
#: bytes.split() without arguments cuts UTF-8 text at exactly these six characters.
WORD = r"[^\x20\x09-\x0D]+"


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for cut lineages and written stages: the cluster's spark.checkpoint.dir, else (tests) a new one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="docwatch-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint, which outlives lost executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the columns an operator works on, under its own names, so that other columns can't clash with them."""
    return df.select(*(F.col(f"`{name}`").alias(alias) for alias, name in wanted.items()))


def plain(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ..., which clash with nothing and hold no dots; toDF(*df.columns) names them back."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def named(df: DataFrame) -> list[Column]:
    """The columns of df, whatever their names."""
    return [F.col(f"`{c}`") for c in df.columns]


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n nodes' component under edges a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Connected components of edges(u BIGINT, v BIGINT) as (node, root): root is the smallest node of the component.

    First each Arrow batch of edges becomes stars for itself, which hang every node on a smaller one. Then
    alternating large and small stars: every round hangs neighbours on the smallest one seen, so paths
    shrink to stars in logarithmically many rounds. A node's minimum is aggregated before the shuffle and
    checkpointed; the join that hands it back has a plain exchange on either side, so AQE can split a hub.
    Nodes without an edge, or with edges only to themselves, are not returned.
    """

    def minima(both: DataFrame) -> DataFrame:
        return cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))

    def digest(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def contract(batches):
        for batch in batches:
            nodes, ends = np.unique(np.r_[batch.column(0).to_numpy(), batch.column(1).to_numpy()], return_inverse=True)
            label = roots(len(nodes), *np.split(ends, 2))
            at = np.flatnonzero(label != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(nodes[label[at]])], names=["u", "v"])

    checkpoint_folder(edges.sparkSession)
    edges = renewed(edges.select("u", "v").where("u <> v").mapInArrow(contract, "u bigint, v bigint").distinct())
    seen = digest(edges)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(minima(both), "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.distinct())
        low = minima(large)
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = renewed(small.where("u <> v").distinct())
        now = digest(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
