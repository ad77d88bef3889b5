"""Conflict-constrained best-fit packing of documents into bins of `capacity` words.

A document longer than a bin is cut into pieces; full-sized pieces are bins of their own, the rest is packed.
Pieces go largest first. The open bins are ordered by residual; each carries two bitmaps, of the duplicate clusters it
holds and of the sources of which it holds max_per_source pieces. The search starts at the tightest bin that is large
enough and goes on to its successors until one has no conflicting bit; without one a new bin is opened.

Best fit is sequential, so pieces are dealt at random into groups of about group_pieces; a group is packed in one
task, which leaves a few part-filled bins per group. A hot source or cluster is spread evenly by the dealing.

Defined cases: null and empty texts have 0 words and are packed like others (an empty piece needs room 0); null is a
source of its own, apart from one named "None"; repeated rows are pieces of the same cluster and never share a bin; null
ids are kept; of bins that fit equally tight the one opened first is taken; very long texts are cut as above; groups
depend on the rows alone, not on the session's settings; an empty table gives an empty result; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwatch.llm.common import WORD, columns, cut


def cluster_of(text: Column) -> Column:
    """Duplicate cluster of a text: equal after folding case and white space."""
    return F.xxhash64(F.lower(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", " ")))


def numbered(values: list) -> list[int]:
    """Small integers for values, in order of appearance; null is a value of its own."""
    known: dict = {}
    return [known.setdefault(v, len(known)) for v in values]


def best_fit(sizes, clusters, sources, capacity: int, max_per_source: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each piece; pieces come in the order in which they are placed. clusters and sources are small integers."""
    residuals: list[tuple[int, int]] = []
    in_clusters: list[int] = []
    in_full_sources: list[int] = []
    counts: list[dict[int, int]] = []
    bins, offsets = [], []
    for size, cluster, source in zip(sizes, clusters, sources):
        at = bisect_left(residuals, (size, -1))
        while at < len(residuals) and (in_clusters[residuals[at][1]] >> cluster & 1 or in_full_sources[residuals[at][1]] >> source & 1):
            at += 1
        if at < len(residuals):
            left, b = residuals.pop(at)
        else:
            left, b = capacity, len(counts)
            in_clusters.append(0)
            in_full_sources.append(0)
            counts.append({})
        in_clusters[b] |= 1 << cluster
        counts[b][source] = counts[b].get(source, 0) + 1
        if counts[b][source] >= max_per_source:
            in_full_sources[b] |= 1 << source
        bins.append(b)
        offsets.append(capacity - left)
        insort(residuals, (left - size, b))
    return bins, offsets


def pack(docs: DataFrame, capacity: int = 2048, max_per_source: int = 8, group_pieces: int = 2048, seed: int = 13, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, piece, first_word, n_words, bin_id, bin_offset): every word of every document in one piece.

    bin_id is the group's number and the bin's number in it; bin_offset is the place of the piece's first word.
    """
    slim = columns(docs, doc_id=doc_id, source=source, text=text)
    sizes = slim.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("words"), cluster_of(F.col("text")).alias("cluster"))
    sizes = cut(sizes)
    pieces = sizes.select("*", F.posexplode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.col("words") - 1), F.lit(capacity).cast("long"))).alias("piece", "first_word"))
    pieces = pieces.withColumn("n_words", F.least(F.lit(capacity).cast("long"), F.col("words") - F.col("first_word")))
    n = pieces.count()
    groups = max(1, -(-n // group_pieces))
    pieces = pieces.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "piece", "words", "cluster"), F.lit(groups)).cast("int"))

    def work(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("n_words", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("cluster", "ascending")])
        small = {c: numbered(rows.column(c).to_pylist()) for c in ("cluster", "source")}
        bins, offsets = best_fit(rows.column("n_words").to_pylist(), small["cluster"], small["source"], capacity, max_per_source)
        group = rows.column("group")[0].as_py()
        out = rows.select(["doc_id", "source", "piece", "first_word", "n_words"])
        return out.append_column("bin_id", pa.array([f"{group}-{b}" for b in bins])).append_column("bin_offset", pa.array(offsets, pa.int64()))

    kinds = {f.name: f.dataType.simpleString() for f in slim.schema}
    return pieces.select("doc_id", "source", "piece", "first_word", "n_words", "cluster", "group").groupBy("group").applyInArrow(work, f"doc_id {kinds['doc_id']}, source {kinds['source']}, piece int, first_word long, n_words long, bin_id string, bin_offset long")
