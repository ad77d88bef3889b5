"""Many rows without an id: the deal goes by their texts, and results do not hang on the session's shuffle partitions."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from docwatch.llm import mixing, packing, sharding


@pytest.fixture(scope="module")
def nameless(spark):
    n = F.lpad(F.col("id").cast("string"), 6, "0")
    return spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text number "), n).alias("text"), F.lit("s").alias("source"))


def under(spark, partitions, f):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        return f()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_shards(spark, nameless):
    places = lambda: Counter(map(tuple, sharding.shuffle_into_shards(nameless, bucket_bytes=1 << 16).select("text", "shard", "slot").collect()))
    few, many = (under(spark, p, places) for p in (4, 40))
    assert few == many and len(few) == 100_000
    buckets = nameless.groupBy(F.pmod(F.xxhash64(F.lit(7), "doc_id", "text"), F.lit(30)).alias("b")).count().agg(F.max("count")).first()[0]
    assert buckets < 4000


def test_bins(spark, nameless):
    bins = lambda: Counter(map(tuple, packing.pack(nameless).select("n_words", "bin_id", "bin_offset").collect()))
    few, many = (under(spark, p, bins) for p in (4, 40))
    assert few == many
    groups = Counter(k[1].split("-")[0] for k in few.elements())
    assert len(groups) == 49 and max(groups.values()) < 2500


def test_null_source_is_not_the_one_named_none(spark):
    docs = spark.createDataFrame([(k, f"a{k} b c", None if k < 2 else "None") for k in range(4)], "doc_id long, text string, source string")
    assert packing.pack(docs, capacity=100, max_per_source=2).select("bin_id").distinct().count() == 1


def test_mixture(spark, nameless):
    taken = lambda: mixing.plan_mixture(nameless, block_words=1 << 12).agg(F.sum("taken"), F.sum("size")).first()
    few, many = (under(spark, p, taken) for p in (4, 40))
    assert few == many == (300_000, 300_000)
