"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Words and punctuation runs of lower-cased text are hashed to n-gram buckets (uni- and bigrams). The target model is
the smoothed bucket distribution of the labelled good documents, the raw model that of all documents; a document's
log weight is STRENGTH times the mean of log(target / raw) over its n-grams, so that long texts weigh no more than short ones.
The target holds no toxic text: a second ratio, of the document frequencies of hashed words in toxic and in good labelled
documents, sums the evidence of words that are EVIDENT times as frequent in toxic ones at least; beyond the border that
the share `clean` of held-out good documents stays under, a document is taken to be toxic and its weight falls by PENALTY.
Adding standard Gumbel noise (seeded by the row) to the log weights and keeping the k largest samples k documents without
replacement in proportion to the weights.

k is the number of documents whose log weight reaches the threshold that keeps the share `keep` of labelled good
documents that were held out from the target model. Raw counts come from all documents; target, toxic model and borders
from at most max_labelled good and as many toxic documents (the smallest hashes of their ids).

Defined cases: null and empty texts have log weight 0 and no evidence; very long texts are read whole; a document without a
label is judged like any other; repeated and null ids are kept, each row judged for itself; without good labels every
weight is 0 and all documents stay; without toxic labels there is no evidence; ties at the border all stay; an empty table
gives an empty result; other columns, whatever their names, pass through untouched.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from docwatch.llm.common import columns, cut, plain, shuffle_partitions

#: Pseudo-counts of raw text in the target model.
SMOOTH = 1000.0
#: n-grams for which a document's mean log ratio counts; what toxic documents lose; buckets of the words' evidence.
STRENGTH, PENALTY, WORD_BUCKETS = 256.0, 1e6, 1 << 17
#: A word is evidence from this ratio of document frequencies on, and from this number of toxic documents on.
EVIDENT, LEAST_TOXIC = 20.0, 3
TOKENS = re.compile(rb"[a-z0-9_\x80-\xff]+|[^a-z0-9_\x80-\xff\s]+")


class Hashes(dict):
    """token -> hash, remembered for frequent tokens."""

    def __missing__(self, token: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[token] = value = zlib.crc32(token)
        return value


def hashed(text: str | None, hashes: Hashes) -> np.ndarray:
    """Hash of every token; n-grams and words both derive from it, so that a pass cuts each text once."""
    tokens = TOKENS.findall((text or "").encode("utf-8", "surrogatepass").lower())
    return np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))


def ngrams(one: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of every uni- and bigram of hashed tokens."""
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(29)
    return np.concatenate((one, two)).astype(np.int64) % buckets


def words_in(one: np.ndarray) -> np.ndarray:
    """Distinct word buckets of hashed tokens."""
    return np.unique(one.astype(np.int64) % WORD_BUCKETS)


def bucket_counts(docs: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """docs(text, kind) to n-gram counts of (all rows, rows of kind GOOD) and document frequencies of words in rows of kind (GOOD,
    TOXIC). Every task sends one vector; vectors are summed in a tree, so neither rows nor sums grow with what a task reads."""
    length = 2 * buckets + 2 * WORD_BUCKETS

    def count(batches):
        hashes = Hashes()
        total = np.zeros(length, np.int64)
        grams, words = total[: 2 * buckets].reshape(2, buckets), total[2 * buckets :].reshape(2, WORD_BUCKETS)
        for batch in batches:
            for t, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = hashed(t, hashes)
                found = ngrams(tokens, buckets)
                for row in grams[: 2 if kind == GOOD else 1]:
                    if len(found) < buckets // 16:
                        np.add.at(row, found, 1)
                    else:
                        row += np.bincount(found, minlength=buckets)
                if kind in (GOOD, TOXIC):
                    words[int(kind == TOXIC), words_in(tokens)] += 1
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    def add(batches):
        total = np.zeros(length, np.int64)
        for batch in batches:
            for row in batch.column(0):
                total += np.frombuffer(row.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    sums = docs.mapInArrow(count, "counts binary")
    for width in (shuffle_partitions(docs.sparkSession), 4):
        sums = sums.repartition(width).mapInArrow(add, "counts binary")
    total = sum((np.frombuffer(r[0], np.int64) for r in sums.collect()), np.zeros(length, np.int64))
    return total[: 2 * buckets].reshape(2, buckets), total[2 * buckets :].reshape(2, WORD_BUCKETS)


#: What a labelled document is for: models of good text, held-out good text for the borders, models of toxic text.
GOOD, HELD_OUT, TOXIC = 1, 2, 3


def gumbel(doc_id: str, text: str) -> F.Column:
    """Standard Gumbel noise of a row."""
    u = (F.pmod(F.xxhash64(F.lit(17), F.col(f"`{doc_id}`"), F.col(f"`{text}`")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def scores(docs: DataFrame, models: Broadcast, text: str, weight: str, evidence: str, whole: bool = True) -> DataFrame:
    """docs (whole: with its texts) with two more columns: the log weight without penalty, and the toxic evidence."""
    where = docs.columns.index(text)
    held = [k for k in range(len(docs.columns)) if whole or k != where]
    names = [*(docs.columns[k] for k in held), weight, evidence]

    def work(batches):
        hashes, (ratio, toxic) = Hashes(), models.value
        for batch in batches:
            weights, evidences = [], []
            for t in batch.column(where).to_pylist():
                tokens = hashed(t, hashes)
                found = ngrams(tokens, len(ratio))
                weights.append(STRENGTH * float(ratio[found].mean()) if len(found) else 0.0)
                evidences.append(float(toxic[words_in(tokens)].sum()) if len(found) else 0.0)
            arrays = [*(batch.column(k) for k in held), pa.array(weights, pa.float64()), pa.array(evidences, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.mapInArrow(work, StructType([*(docs.schema[k] for k in held), StructField(weight, DoubleType()), StructField(evidence, DoubleType())]))


def kth_largest(scored: DataFrame, k: int, bins: int = 4096) -> float:
    """The k-th largest key: histograms of ever narrower intervals, of which only the counts reach the driver."""
    low, high = scored.agg(F.min("__key"), F.max("__key")).first()
    if low is None or k <= 0:
        return float("inf")
    while low < high:
        width = (high - low) / bins
        if low + width == low or high - width == high:
            break
        at = F.least(F.lit(bins - 1), F.floor((F.col("__key") - low) / width)).cast("int")
        inside = scored.where(F.col("__key").between(low, high))
        parts = {r[0]: r[1:] for r in inside.groupBy(at.alias("b")).agg(F.count("*"), F.min("__key"), F.max("__key")).collect()}
        for b in sorted(parts, reverse=True):
            n, low, high = parts[b]
            if k <= n:
                break
            k -= n
    return low


@dataclass(frozen=True)
class Sampler:
    """A fitted resampler: the broadcast log ratios of n-grams and words, the toxic border and the smallest key that is kept;
    scored holds (doc_id, weight, __key) of the rows it was fitted on."""

    models: Broadcast
    toxic_border: float
    border: float
    scored: DataFrame
    doc_id: str
    text: str

    def fitted(self) -> DataFrame:
        """(doc_id, log_weight, kept) of the rows that fit() was given."""
        return self.scored.select("doc_id", F.col("weight").alias("log_weight"), (F.col("__key") >= self.border).alias("kept"))

    def judge(self, docs: DataFrame) -> DataFrame:
        """(doc_id, log_weight, kept): a row per row of docs."""
        slim = columns(docs, doc_id=self.doc_id, text=self.text)
        scored = scores(slim.withColumn("noise", gumbel("doc_id", "text")), self.models, "text", "raw", "evidence", whole=False)
        weighed = scored.withColumn("log_weight", penalised("raw", "evidence", self.toxic_border))
        return weighed.select("doc_id", "log_weight", (F.col("log_weight") + F.col("noise") >= self.border).alias("kept"))

    def select(self, docs: DataFrame) -> DataFrame:
        """The rows of docs that the sample keeps. Weights and noise are functions of the row, so no join is needed."""
        rows, of = plain(docs), dict(zip(docs.columns, plain(docs).columns))
        key = penalised("weight", "evidence", self.toxic_border) + gumbel(of[self.doc_id], of[self.text])
        return scores(rows, self.models, of[self.text], "weight", "evidence").where(key >= self.border).select(*rows.columns).toDF(*docs.columns)


def penalised(weight: str, evidence: str, border: float) -> F.Column:
    return F.col(weight) - F.when(F.col(evidence) > border, PENALTY).otherwise(0.0)


def fit(docs: DataFrame, labels: DataFrame, keep: float = 0.998, clean: float = 0.995, buckets: int = 1 << 15, max_labelled: int = 20_000, doc_id: str = "doc_id", text: str = "text") -> Sampler:
    """labels(doc_id, quality, toxic): a good document has quality 1 and is not toxic."""
    slim = columns(docs, doc_id=doc_id, text=text)
    toxic = F.coalesce("toxic", F.lit(0)) == 1
    marked = columns(labels, doc_id="doc_id", quality="quality", toxic="toxic").where("doc_id is not null").groupBy("doc_id").agg(F.max(toxic).alias("toxic"), F.max((F.col("quality") == 1) & ~toxic).alias("good"))
    chosen = lambda which: marked.where(which).orderBy(F.xxhash64(F.lit(23), "doc_id"), "doc_id").limit(max_labelled)
    held_out = F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.lit(4)) == 0
    good = chosen("good").select("doc_id", F.when(held_out, HELD_OUT).otherwise(GOOD).alias("kind"))
    marks = F.broadcast(cut(good.union(chosen("toxic and not good").select("doc_id", F.lit(TOXIC)))))  # 2 * max_labelled rows at most
    (raw, target), (in_good, in_toxic) = bucket_counts(slim.join(marks, "doc_id", "left").select("text", "kind"), buckets)
    n = slim.join(marks, "doc_id").groupBy("kind").count()
    sizes = {r[0]: r[1] for r in n.collect()}  # three rows
    ratio = np.zeros(buckets)
    if target.sum():
        background = (raw + 1e-9) / raw.sum()
        ratio = np.log((target + SMOOTH * background) / (target.sum() + SMOOTH)) - np.log(background)
        ratio[raw == 0] = 0
    words = np.log((in_toxic + 0.5) / (sizes.get(TOXIC, 0) + 1)) - np.log((in_good + 0.5) / (sizes.get(GOOD, 0) + 1))
    words = np.where((words >= np.log(EVIDENT)) & (in_toxic >= LEAST_TOXIC), words, 0.0)
    models = docs.sparkSession.sparkContext.broadcast((ratio, words))
    rated = cut(scores(slim.withColumn("noise", gumbel("doc_id", "text")), models, "text", "raw", "evidence", whole=False))
    held = rated.join(marks, "doc_id").where(F.col("kind") == HELD_OUT)  # a quarter of max_labelled rows
    threshold, border = held.agg(F.percentile("raw", F.lit(1 - keep)), F.percentile("evidence", F.lit(clean))).first()
    border = float("inf") if border is None else border
    weighed = rated.select("doc_id", penalised("raw", "evidence", border).alias("weight"), "noise")
    scored = weighed.withColumn("__key", F.col("weight") + F.col("noise"))
    k = scored.where(F.col("weight") >= threshold).count() if threshold is not None else scored.count()
    return Sampler(models, border, kth_largest(scored, k), scored, doc_id, text)
