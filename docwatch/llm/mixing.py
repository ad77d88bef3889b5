"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame functions only.

1. Targets: sources share the total words by weight; a target stops at max_repeat times its source's words and the
   excess is reshared by weight (water filling, in closed form over the sources ordered by cap / weight).
2. Blocks: a source's documents are dealt by a seeded hash into blocks of about block_words words. A quota is as many
   passes over all blocks as fit into the target plus the leading blocks of a seeded permutation; the block at the
   border gives up exactly the words still missing, its documents in hashed order, the last one in part.
3. Tree: the vector of block quotas is split in two again and again until there is one vector per output shard; each
   split is an exact multivariate hypergeometric draw (units drawn one by one without replacement).
4. Shards take consecutive, hence disjoint, runs of each source's permuted blocks and shuffle rows by a hash.

Defined cases: null text has size 0; null is a source of its own, ordered last; a source without words has target 0;
repeated rows are documents of their own; null ids are allowed; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docwatch.llm.common import WORD, columns, cut

WEIGHTS = (5, 2, 1)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = 3) -> DataFrame:
    """(rank, source, source_size, n_docs, target) per source of sizes(source, size); one row per source is ranked in one task."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    per = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("long"))
    per = per.withColumn("cap", F.col("source_size") * max_repeat).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "rank")
    everything = Window.partitionBy(F.lit(0))
    per = per.withColumn("total", F.sum("source_size").over(everything))
    per = per.withColumn("capped", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    per = per.withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    per = per.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(everything)
    per = per.withColumn("level", first["level"])
    return per.select("rank", "source", "source_size", "n_docs", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def split_once(quotas: Column, node: Column, level: int, seed: int) -> Column:
    """Quota vector to STRUCT<left, right>: how many units of each source an exact draw of half the units takes."""
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda n, s: n + s["q"])
    number = F.lit(0).cast("long")

    def unit(s, state):
        def draw(a, j):
            u = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), node, s["rank"], j), F.lit(1 << 40)) / float(1 << 40)
            hit = (u * a["units"] < a["slots"]).cast("long")
            return F.struct((a["slots"] - hit).alias("slots"), (a["units"] - 1).alias("units"), (a["x"] + hit).alias("x"))

        numbers = F.when(s["q"] > 0, F.sequence(F.lit(1).cast("long"), s["q"])).otherwise(F.array().cast("array<bigint>"))
        return F.aggregate(numbers, F.struct(state["slots"].alias("slots"), state["units"].alias("units"), number.alias("x")), draw)

    none = F.array().cast("array<struct<rank:int,q:bigint>>")
    begin = F.struct(F.floor(total / 2).alias("slots"), total.alias("units"), none.alias("left"), none.alias("right"))

    def source(state, s):
        drawn = F.transform(F.array(unit(s, state)), lambda d: F.struct(
            d["slots"].alias("slots"), d["units"].alias("units"),
            F.concat(state["left"], F.array(F.struct(s["rank"].alias("rank"), d["x"].alias("q")))).alias("left"),
            F.concat(state["right"], F.array(F.struct(s["rank"].alias("rank"), (s["q"] - d["x"]).alias("q")))).alias("right")))
        return drawn[0]

    return F.aggregate(quotas, begin, source)


def splitting_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """quotas(rank, q) to (rank, shard, q): each shard's exact quota of every source. shards is a power of two."""
    levels = int(math.log2(shards))
    if 1 << levels != shards:
        raise ValueError("shards must be a power of two")
    nodes = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), F.col("q").cast("long").alias("q")))).alias("quotas"))
    nodes = nodes.select(F.lit(0).alias("node"), "quotas")
    for level in range(levels):
        halves = nodes.select("node", split_once(F.col("quotas"), F.col("node"), level, seed).alias("h"))
        both = F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), F.col("h.left").alias("quotas")), F.struct((F.col("node") * 2 + 1).alias("node"), F.col("h.right").alias("quotas"))))
        nodes = halves.select(both.alias("n")).select("n.node", "n.quotas")
    return nodes.select(F.col("node").alias("shard"), F.inline("quotas"))


def plan_mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = 3, shards: int = 16, block_words: int = 1 << 16, seed: int = 11, doc_id: str = "doc_id", text: str = "text", source: str = "source", carry: bool = False) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, shards): a row per row of docs, which carry adds as STRUCT row.

    shards lists, copy by copy, the output shards that receive the document; taken counts its words over all copies
    (the last copy of one document per source is cut so that the source meets its target exactly).
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text"), *([F.struct("*").alias("row")] if carry else []))
    measured = rows.select("doc_id", "source", size.alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"), *(["row"] if carry else []))
    slim = cut(measured.drop("row"))
    per = cut(targets(slim, weights, max_repeat))
    words = max(block_words, (per.agg(F.sum("source_size")).first()[0] or 0) >> 20)  # a million blocks at most
    per = per.withColumn("blocks", F.ceil(F.greatest(F.col("source_size"), F.col("n_docs") * 64, F.lit(1)) / words).cast("long"))
    per = per.withColumn("want", F.round("target").cast("long")).withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("want") / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long"))
    per = per.withColumn("rest", F.col("want") - F.col("passes") * F.col("source_size"))
    per = cut(per)

    def place(rows: DataFrame) -> DataFrame:
        return rows.join(per, rows.source.eqNullSafe(per.source)).drop(per.source).withColumn("block", F.pmod("h", "blocks"))

    blocks = place(slim).groupBy("rank", "block").agg(F.sum("size").alias("words"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
    turn = F.xxhash64(F.lit(seed + 1), "rank", "block")
    before = Window.partitionBy("rank").orderBy(turn, "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    blocks = blocks.withColumn("part", F.greatest(F.lit(0).cast("long"), F.least("words", F.col("rest") - F.col("before"))))
    blocks = cut(blocks.withColumn("copies", F.col("passes") + (F.col("part") > 0).cast("long")))

    units = blocks.where("copies > 0").select("rank", "block", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    units = units.withColumn("number", F.row_number().over(Window.partitionBy("rank").orderBy(F.xxhash64(F.lit(seed + 2), "rank", "block", "copy"), "block", "copy")).cast("long"))
    leaves = splitting_tree(blocks.groupBy("rank").agg(F.sum("copies").alias("q")), shards, seed)
    upto = F.sum("q").over(Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    leaves = leaves.withColumn("upto", upto).where("q > 0")
    drawn = leaves.select("rank", "shard", F.explode(F.sequence(F.col("upto") - F.col("q") + 1, "upto")).alias("number"))
    given = units.join(drawn, ["rank", "number"]).groupBy("rank", "block").agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("dealt"))
    quota = cut(blocks.select("rank", "block", "words", "part").join(given, ["rank", "block"], "left"))

    out = place(measured if carry else slim).join(quota, ["rank", "block"])
    ahead = F.coalesce(F.sum("size").over(Window.partitionBy("rank", "block").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = out.withColumn("rest_here", F.greatest(F.lit(0).cast("long"), F.least("size", F.col("part") - ahead)))
    copies = F.when(F.col("size") > 0, F.col("passes") + (F.col("rest_here") > 0).cast("long")).otherwise(0).cast("int")
    shards = F.slice(F.coalesce("dealt.shard", F.array().cast("array<int>")), F.lit(1), copies)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("rest_here")).alias("taken"), shards.alias("shards"), *(["row"] if carry else []))


def mixed_documents(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mixture as rows of docs: one per copy; the copy at a source's border keeps its leading words."""
    plan = plan_mixture(docs, text=text, carry=True, **options)
    rows = plan.select("size", "taken", "row", F.posexplode("shards").alias("copy", "shard"))
    words = (F.col("taken") - F.col("copy") * F.col("size")).cast("int")
    whole = F.col("row").getField(text)
    cut_text = F.when(words >= F.col("size"), whole).otherwise(F.array_join(F.slice(F.regexp_extract_all(whole, F.lit(f"({WORD})"), 1), F.lit(1), words), " "))
    return rows.select(*(cut_text.alias(text) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns))


def mix(docs: DataFrame, **options) -> DataFrame:
    """plan_mixture as rows of the mixture: (doc_id, shard, copy, words, turn); readers of a shard sort by turn, its local shuffle."""
    plan = plan_mixture(docs, **options)
    rows = plan.where("taken > 0").select("doc_id", "size", "taken", F.posexplode("shards").alias("copy", "shard"))
    words = F.least("size", F.col("taken") - F.col("copy") * F.col("size"))
    return rows.withColumn("words", words).where("words > 0").select("doc_id", "shard", "copy", "words", F.xxhash64("shard", "copy", "doc_id").alias("turn"))
