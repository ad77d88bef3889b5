"""Substring dedup with difference-cover anchors.

A window is `window` consecutive words. Its words go if the same sequence also starts earlier (smaller doc_id, or the
same document and an earlier start). Anchors of `window - period + 1` words are hashed only where the word's position
modulo `period` lies in a difference cover: for any two positions some shift below `period` puts both on cover
positions, so two equal windows always share an aligned anchor. Documents whose whole text an earlier one has are
known by two hashes; they lose all words (if they have a window at all) and take no further part. The others go
through three passes over chunks of documents:

1. a chunk reports each anchor hash once; hashes seen twice in the corpus are handed back to their chunks;
2. the windows around such anchors are hashed whole (96 bits); a chunk reports each once, with its first place in it;
3. windows that occur twice come back, marked where their first place of all lies; at all others the words go.

Whatever is shared by how many documents, an exchange sees it at most once per chunk. Chunks hold chunk_bytes of text
and are dealt by hash, the texts are shuffled once (compressed) and that exchange serves all three passes.

Defined cases: null text has no words; documents without a repeated window keep their text (words joined by one
space); a null id counts as larger than all others; equal ids are one document, of which windows at equal starts do
not precede each other; a very long text is worked on whole, in a chunk of its size; an empty table gives an empty result;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docwatch.llm.common import columns, cut, shuffle_partitions

#: A perfect difference set: every residue modulo 13 is a difference of two of its members.
PERIOD, COVER = 13, (0, 1, 3, 9)
FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
LAST = (1 << 63) - 1
KEY = np.dtype([("a", "<i8"), ("b", "<i4")])


class Chunk:
    """The words of a chunk's documents, one after another."""

    def __init__(self, rows: pa.Table, copies: pa.Table, window: int):
        """Documents that copies(x, y) names by id and text hash count as having no words; size has their true number."""
        self.window = window
        self.ids = np.array([LAST if x is None else x for x in rows.column("doc_id").to_pylist()], np.int64)
        unzip = zstandard.ZstdDecompressor().decompress
        self.words = [unzip(z).split() for z in rows.column("text").to_pylist()]
        self.size = np.array([len(w) for w in self.words], np.int64)
        named = set(zip(copies.column("x").to_pylist(), copies.column("y").to_pylist()))
        self.is_copy = np.array([k in named for k in zip(self.ids.tolist(), rows.column("k").to_pylist())], bool)
        for i in np.flatnonzero(self.is_copy):
            self.words[i] = []
        sizes = np.where(self.is_copy, 0, self.size)
        self.begin = np.r_[0, np.cumsum(sizes)]
        n = int(self.begin[-1])
        self.hash = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(self.words)), np.uint64, n)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.place = np.arange(n) - self.begin[self.doc]
        self.left = self.begin[self.doc + 1] - np.arange(n)

    def rolled(self, length: int, factor: int) -> np.ndarray:
        """Polynomial hash of the length words from each position, modulo 2**64; meaningless where fewer are left."""
        n = len(self.hash)
        if n < length:
            return np.zeros(n, np.uint64)
        power = np.full(n + 1, factor, np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        sums = np.r_[np.uint64(0), np.add.accumulate(self.hash * power[:n])]
        inverse = np.full(n + 1, pow(factor, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        inverse = np.multiply.accumulate(inverse)
        out = np.zeros(n, np.uint64)
        out[: n - length + 1] = (sums[length:] - sums[: n - length + 1]) * inverse[: n - length + 1]
        return out

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        length = self.window - PERIOD + 1
        at = np.flatnonzero(np.isin(self.place % PERIOD, COVER) & (self.left >= length))
        return at, (self.rolled(length, FACTORS[0])[at] >> np.uint64(16)).view(np.int64)  # 48 bits: a collision costs a check, not a word

    def windows(self) -> np.ndarray:
        """96-bit hash of the window from each position, as a structured array."""
        out = np.zeros(len(self.hash), KEY)
        out["a"] = self.rolled(self.window, FACTORS[0]).view(np.int64)
        out["b"] = (self.rolled(self.window, FACTORS[1]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        return out


def remove_repeats(docs: DataFrame, window: int = 20, chunk_bytes: int = 4 << 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kept_text, n_words, n_removed): a row per row of docs."""
    if window < PERIOD:
        raise ValueError(f"a window has at least {PERIOD} words")
    slim = columns(docs, doc_id=doc_id, text=text)
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(total // chunk_bytes + 1, 4 * shuffle_partitions(docs.sparkSession))

    def zipped(batches):
        zip_ = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = pa.array([zip_((t or "").encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("doc_id"), batch.column("k"), texts], names=["chunk", "doc_id", "k", "text"])

    k = F.xxhash64(F.coalesce("text", F.lit("")))
    dealt = slim.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"), F.col("doc_id").cast("long").alias("doc_id"), k.alias("k"), "text")
    by_chunk = dealt.mapInArrow(zipped, "chunk long, doc_id long, k long, text binary").groupBy("chunk")
    keyed = dealt.select("chunk", F.coalesce("doc_id", F.lit(LAST)).alias("x"), F.col("k").alias("y"), F.xxhash64(F.lit(1), F.coalesce("text", F.lit(""))).alias("k2"))
    firsts = cut(keyed.groupBy("y", "k2").agg(F.min("x").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    none = F.lit(None)
    copies = cut(keyed.join(firsts, ["y", "k2"]).where("x > first").select("chunk", "x", "y", none.cast("boolean").alias("keep")))

    def apart(found: pa.Table) -> tuple[pa.Table, pa.Table]:
        """(rows about hashes, rows about copies)."""
        about_copy = pc.is_null(found.column("keep"))
        return found.filter(pc.invert(about_copy)), found.filter(about_copy)

    def report_anchors(rows: pa.Table, copied: pa.Table) -> pa.Table:
        hashed, n = np.unique(Chunk(rows, copied, window).anchors()[1] if rows.num_rows else np.zeros(0, np.int64), return_counts=True)
        return pa.table({"h": hashed, "chunk": np.full(len(hashed), rows.column("chunk")[0].as_py() if len(hashed) else 0), "n": np.minimum(n, 2).astype(np.int32)})

    anchors = by_chunk.cogroup(copies.groupBy("chunk")).applyInArrow(report_anchors, "h long, chunk long, n int")
    shared = anchors.withColumn("all", F.sum("n").over(Window.partitionBy("h"))).where("`all` > 1").select("chunk", F.col("h").alias("x"), none.cast("long").alias("y"), F.lit(True).alias("keep"))

    def report_windows(rows: pa.Table, found: pa.Table) -> pa.Table:
        first, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        key, ids, places = np.zeros(0, KEY), np.zeros(0, np.int64), np.zeros(0, np.int64)
        found, copied = apart(found)
        if rows.num_rows and found.num_rows:
            c = Chunk(rows, copied, window)
            at, h = c.anchors()
            at = at[np.isin(h, found.column("x").to_numpy())]
            mark = np.zeros(len(c.hash) + 1, np.int64)  # starts from at - (PERIOD - 1) to at, in the document
            np.add.at(mark, np.maximum(at - (PERIOD - 1), c.begin[c.doc[at]]), 1)
            np.add.at(mark, at + 1, -1)
            starts = np.flatnonzero((np.cumsum(mark[:-1]) > 0) & (c.left >= window))
            key, ids, places = c.windows()[starts], c.ids[c.doc[starts]], c.place[starts]
            order = np.lexsort((places, ids, key["b"], key["a"]))
            new = np.r_[True, key[order][1:] != key[order][:-1]] if len(order) else np.zeros(0, bool)
            n = np.diff(np.r_[np.flatnonzero(new), len(order)])
            back = np.argsort(order[new], kind="stable")  # neighbours in the text stay neighbours, which compresses well
            first, n = order[new][back], np.minimum(n[back], 2)
        chunk = found.column("chunk")[0].as_py() if found.num_rows else 0
        return pa.table({"a": key["a"][first], "b": key["b"][first], "start": places[first].astype(np.int32), "n": n.astype(np.int32), "doc": ids[first], "chunk": np.full(len(first), chunk)})

    windows = by_chunk.cogroup(shared.union(copies).groupBy("chunk")).applyInArrow(report_windows, "a long, b int, start int, n int, doc long, chunk long")
    key = Window.partitionBy("a", "b")
    here = F.struct("doc", "start")
    judged = windows.withColumn("all", F.sum("n").over(key)).withColumn("keep", F.min(here).over(key) == here)
    repeated = judged.where("`all` > 1 and not (keep and n = 1)").select("chunk", F.col("a").alias("x"), F.col("b").cast("long").alias("y"), "keep")

    def cut_out(rows: pa.Table, found: pa.Table) -> pa.Table:
        found, copied = apart(found)
        c = Chunk(rows, copied, window) if rows.num_rows else None
        kept, removed = [], np.zeros(rows.num_rows, np.int64)
        if c and found.num_rows:
            keys = np.zeros(found.num_rows, KEY)
            keys["a"], keys["b"] = found.column("x").to_numpy(), found.column("y").to_numpy()
            order = np.argsort(keys)
            keys, keep = keys[order], found.column("keep").to_numpy(zero_copy_only=False)[order]
            all_windows = c.windows()
            maybe = np.flatnonzero((c.left >= window) & np.isin(all_windows["a"], keys["a"]))
            k = np.minimum(np.searchsorted(keys, all_windows[maybe]), len(keys) - 1)
            hit = keys[k] == all_windows[maybe]
            maybe, k = maybe[hit], k[hit]
            # of a window whose first place of all is in this chunk, the places with the least id and start stay
            order = np.lexsort((c.place[maybe], c.ids[c.doc[maybe]], k))
            least = np.zeros(len(maybe), bool)
            if len(order):
                k_, id_, place_ = k[order], c.ids[c.doc[maybe]][order], c.place[maybe][order]
                head = np.flatnonzero(np.r_[True, k_[1:] != k_[:-1]])
                of = np.repeat(head, np.diff(np.r_[head, len(order)]))
                least[order] = (id_ == id_[of]) & (place_ == place_[of])
            gone_at = maybe[~(keep[k] & least)]
            mark = np.zeros(len(c.hash) + 1, np.int64)
            np.add.at(mark, gone_at, 1)
            np.add.at(mark, gone_at + window, -1)
            gone = np.cumsum(mark[:-1]) > 0
            sums = np.r_[0, np.cumsum(gone)]
            removed = sums[c.begin[1:]] - sums[c.begin[:-1]]
        unzip = zstandard.ZstdDecompressor().decompress
        for i in range(rows.num_rows):
            ws = c.words[i]
            if c.is_copy[i]:
                removed[i] = c.size[i] if c.size[i] >= window else 0
                ws = [] if removed[i] else unzip(rows.column("text")[i].as_py()).split()
            elif removed[i]:
                ws = [w for w, g in zip(ws, gone[c.begin[i] : c.begin[i + 1]].tolist()) if not g]
            kept.append(b" ".join(ws))
        texts = pa.array(kept, pa.binary()).cast(pa.string())
        n = c.size if c else np.zeros(0, np.int64)
        return pa.table({"doc_id": rows.column("doc_id"), "kept_text": texts, "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64())})

    return by_chunk.cogroup(repeated.union(copies).groupBy("chunk")).applyInArrow(cut_out, "doc_id long, kept_text string, n_words long, n_removed long")
