"""Exact top-k search: tiled matrix products, partial selection per tile, tree merge of the per-query lists.

Vectors are packed by hash into shards and queries into blocks, a row each. Every block meets every shard in a tile
of its own: one matrix product and a selection of k per query. A shard's task gets its candidates once, then the blocks
one after the other. Lists are merged in two levels, so no task sees more than k entries from each of about
sqrt(shards) lists.

Components become floor(scale * x); scores are integer inner products, summed as doubles while they stay below 2**53
and as Python integers beyond. Defined cases: vectors that are null, or hold null or non-finite components, take no
part; nor do rows without an id; rows that repeat an id are rows of their own, as queries (a list each) and as candidates
(also of each other); vectors of different lengths don't meet; ties go to the smaller id; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docwatch.llm.common import columns, cut

LONG = (1 << 63) - 1


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the lower position, highest first."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.argsort(-scores[at], kind="stable")][:k]


def search(q_ids, q_rows, q, c_ids, c_rows, c, k: int, step: int = 128):
    """Lists (query id, query row, candidate id, score) of one tile; candidates are sorted by id."""
    top = lambda m: float(np.abs(m).max(initial=0))
    exact = top(q) * top(c) * max(1, q.shape[1]) < 2**53
    if not exact:
        q, c = (np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape) for m in (q, c))
    for a in range(0, len(q_ids), step):
        tile = q[a : a + step] @ c.T
        for i, (query, number) in enumerate(zip(q_ids[a : a + step], q_rows[a : a + step])):
            row = tile[i]
            keep = np.flatnonzero(c_rows != number)
            if exact:
                at = keep[best(row[keep], k)]
            else:
                at = np.array(sorted(keep, key=lambda j: (-row[j], j))[:k], dtype=np.int64)
            for j in at:
                yield int(query), int(number), int(c_ids[j]), max(-LONG - 1, min(LONG, int(row[j])))


def pack(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("vec_id", "ascending"), ("row", "ascending")])
    matrix = np.floor(rows.column("scaled").combine_chunks().flatten().to_numpy(zero_copy_only=False))
    ids, numbers = (pa.array([rows.column(c).to_numpy().astype(np.int64).tobytes()], pa.binary()) for c in ("vec_id", "row"))
    return pa.table({"dim": rows.column("dim")[:1], "part": rows.column("part")[:1], "ids": ids, "numbers": numbers, "matrix": pa.array([matrix.astype(np.float64).tobytes()], pa.binary())})


def top_k(vectors: DataFrame, is_query: str, k: int = 5, scale: int = 256, shard_rows: int = 8192, block_rows: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows for each row that is_query, an SQL condition on vec_id, picks."""
    rows = columns(vectors, vec_id=vec_id, embedding=embedding).where("vec_id is not null and embedding is not null")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = rows.where(finite).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double") * F.lit(float(scale))).alias("scaled"), F.size("embedding").alias("dim"))
    rows = cut(rows)  # from here on the row numbers are fixed
    n, asked = rows.agg(F.count("*"), F.count_if(F.expr(is_query))).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-asked // block_rows))
    packed = "dim int, part int, ids binary, numbers binary, matrix binary"
    dealt = lambda df, parts: df.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")).groupBy("dim", "part").applyInArrow(pack, packed)
    side = lambda df, shard, asks: df.select("dim", shard.alias("shard"), F.lit(asks).alias("asks"), "ids", "numbers", "matrix")
    c = side(dealt(rows, shards), F.col("part"), False)
    q = side(dealt(rows.where(is_query), blocks), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))), True)
    tiles = c.union(q).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "asks")  # no join: the planner takes the copies of q for one, and would broadcast them

    def work(batches):
        held, c_ids, c_rows, c_matrix = None, None, None, None  # the shard at hand, whose candidates come before its queries
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                key, of = (row["dim"].as_py(), row["shard"].as_py()), lambda c, kind=np.int64: np.frombuffer(row[c].as_buffer(), kind)  # noqa: E731, B023
                ids, numbers, matrix = of("ids"), of("numbers"), of("matrix", np.float64)
                matrix = matrix.reshape(len(ids), key[0])
                if not row["asks"].as_py():
                    held, c_ids, c_rows, c_matrix = key, ids.copy(), numbers.copy(), matrix.copy()
                elif key == held:
                    found = list(search(ids, numbers, matrix, c_ids, c_rows, c_matrix, k))
                    parts = [np.array(x, np.int64) for x in (zip(*found) if found else [()] * 4)]
                    shard = pa.array(np.full(len(parts[0]), key[1], np.int32))
                    yield pa.RecordBatch.from_arrays([shard, *map(pa.array, parts)], names=["shard", "query_id", "query_row", "vec_id", "score"])

    lists = tiles.mapInArrow(work, "shard int, query_id long, query_row long, vec_id long, score long")
    groups = max(1, int(shards**0.5))
    order = [F.desc("score"), F.asc("vec_id")]
    first = F.row_number().over(Window.partitionBy("query_row", F.pmod("shard", F.lit(groups))).orderBy(*order))
    merged = lists.withColumn("rank", first).where(F.col("rank") <= k).drop("rank")
    last = F.row_number().over(Window.partitionBy("query_row").orderBy(*order))
    return merged.withColumn("rank", last).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
