"""Two-pass external shuffle into shards.

Pass one scatters the rows into memory-sized buckets by a seeded hash; pass two puts each bucket into a fixed order,
applies a seeded Fisher-Yates shuffle to it and numbers the rows on from the buckets before it. Position p of the
whole shuffled sequence goes to shard p mod shards, slot p div shards, so shard counts differ by one at most.

Defined cases: null text has size 1 (no bytes, plus the separator) and no checksum bytes; null ids are ordinary
ids; repeated rows each get a place of their own, in one bucket if id and text are equal; a text longer than a bucket has
a larger one; equal texts need not share a shard under this law; places depend on the rows alone, not on the session's
settings; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docwatch.llm.common import columns, cut, shuffle_partitions

#: Buckets whose offsets are summed together; bytes of text that a task of the second pass reads.
COARSE, TASK_BYTES = 4096, 64 << 20


def shuffle_into_shards(docs: DataFrame, shards: int = 16, seed: int = 7, bucket_bytes: int = 8 << 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, size, position, shard, slot): every row of docs once, in a seeded random order.

    bucket_bytes bounds what a task holds of the texts; the number of buckets follows the measured total.
    """
    slim = columns(docs, doc_id=doc_id, text=text).withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)
    total = slim.agg(F.sum("size")).first()[0] or 0
    buckets = total // bucket_bytes + 1
    bucket = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(buckets))
    held = cut(slim.groupBy(bucket.alias("bucket")).count().withColumn("part", F.floor(F.col("bucket") / COARSE)))
    ahead = lambda w, n: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    parts = held.groupBy("part").agg(F.sum("count").alias("n")).select("part", ahead(Window.orderBy("part"), "n").alias("base"))
    offsets = held.withColumn("inner", ahead(Window.partitionBy("part").orderBy("bucket"), "count")).join(parts, "part").select("bucket", (F.col("base") + F.col("inner")).alias("start"))

    def mix(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        number = rows.column("bucket")[0].as_py()
        order = np.random.default_rng([seed, number]).permutation(rows.num_rows)  # Fisher-Yates
        rows = rows.take(pa.array(order))
        position = pa.array(np.arange(rows.num_rows, dtype=np.int64) + rows.column("start")[0].as_py())
        return rows.select(["doc_id", "text", "size"]).append_column("position", position)

    kind = slim.schema["doc_id"].dataType.simpleString()
    # as many partitions as the sizes ask for, whatever the session's setting; a bucket is still a group of its own
    width = min(buckets, max(shuffle_partitions(docs.sparkSession), total // TASK_BYTES + 1))
    placed = slim.withColumn("bucket", bucket).join(offsets, "bucket").repartition(width, "bucket").groupBy("bucket").applyInArrow(mix, f"doc_id {kind}, text string, size bigint, position bigint")
    return placed.withColumn("shard", F.pmod("position", F.lit(shards)).cast("int")).withColumn("slot", F.floor(F.col("position") / shards))


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder per shard, in it files whose rows are sorted by slot."""
    n = shuffle_partitions(shuffled.sparkSession)
    shuffled.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
