"""Document fingerprints: a Merkle tree over sections and paragraphs. DataFrame functions only.

Sections end at blank lines. A section's paragraphs are its lines, a line of several sentences is cut after each
sentence end, and what is still longer than LONG characters into stretches of half of that, so that long lines have
branches too; nothing is lost between the cuts. A paragraph hashes its text, a section its paragraphs' hashes, the
root its sections' hashes (SHA-256). The fingerprint prints the tree from the root:
`root:section(leaf,leaf)section(leaf)`, sections and leaves shortened to 12 hex digits.

Equal roots mean equal texts; unequal branches locate an edit. Likeness is the Dice coefficient of the distinct
leaves: 1 for equal trees, 0 for trees without a common leaf; two empty texts have 1.

Defined cases: null text counts as empty (one empty paragraph); very long texts have as many leaves as they need; repeated
rows are documents of their own; of rows with equal ids the one with the smaller text comes first; a null id comes after
all others; in a one-row table a document is its own successor; an empty table gives an empty result; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docwatch.llm.common import columns, shuffle_partitions

SECTION, PARAGRAPH = r"(?<=\n\n)", r"(?<=\n)|(?<=[.!?] )"
LONG = 200
LAST = (1 << 63) - 1


def tree(text: Column) -> Column:
    """ARRAY<ARRAY<STRING>>: the leaves' SHA-256, section by section."""
    pieces = lambda t, cut: F.filter(F.split(t, cut), lambda x: x != "")
    short = lambda p: F.when(F.length(p) > LONG, F.regexp_extract_all(p, F.lit(f"(?s).{{1,{LONG // 2}}}"), F.lit(0))).otherwise(F.array(p))
    paragraphs = lambda s: F.flatten(F.transform(pieces(s, PARAGRAPH), short))
    sections = F.transform(pieces(text, SECTION), lambda s: F.transform(paragraphs(s), lambda p: F.sha2(p, 256)))
    return F.when(text == "", F.array(F.array(F.sha2(text, 256)))).otherwise(sections)


def branch(section: Column) -> Column:
    """Hash of a section's leaves."""
    return F.sha2(F.array_join(section, ""), 256)


def root(leaves: Column) -> Column:
    return F.sha2(F.array_join(F.transform(leaves, branch), ""), 256)


def fingerprint(leaves: Column) -> Column:
    short = lambda x: F.substring(x, 1, 12)
    printed = F.transform(leaves, lambda s: F.concat(short(branch(s)), F.lit("("), F.array_join(F.transform(s, short), ","), F.lit(")")))
    return F.concat(root(leaves), F.lit(":"), F.array_join(printed, ""))


def leaf_set(leaves: Column) -> Column:
    return F.array_distinct(F.flatten(leaves))


def likeness(a: Column, b: Column, a_leaves: Column, b_leaves: Column, same_root: Column) -> Column:
    """Dice coefficient of the distinct leaves of trees a and b, whose leaf sets are given: 1 where the roots agree. Otherwise the
    leaves of branches that both trees have are common, and only those of differing branches are looked up."""
    agreeing, differing = F.flatten(F.array_intersect(a, b)), F.flatten(F.array_except(a, b))
    common = F.size(F.array_distinct(F.concat(agreeing, F.array_intersect(differing, b_leaves))))
    return F.when(same_root, F.lit(1.0)).otherwise(F.lit(2.0) * common / (F.size(a_leaves) + F.size(b_leaves)))


def differing_branches(a: Column, b: Column) -> Column:
    """ARRAY<STRUCT<section, paragraph>> (from 0): where the leaves of tree a differ from those at the same place of tree b."""
    number = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def section(i):
        x, y = F.get(a, i), F.get(b, i)
        odd = F.filter(number(F.greatest(F.size(F.coalesce(x, F.array().cast("array<string>"))), F.size(F.coalesce(y, F.array().cast("array<string>"))))), lambda j: ~F.get(x, j).eqNullSafe(F.get(y, j)))
        return F.transform(odd, lambda j: F.struct(i.alias("section"), j.alias("paragraph")))

    differing = F.filter(number(F.greatest(F.size(a), F.size(b))), lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i)))
    return F.flatten(F.transform(differing, section))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, leaves)."""
    leaves = tree(F.coalesce("text", F.lit("")))
    return columns(docs, doc_id=doc_id, text=text).select("doc_id", leaves.alias("leaves")).select("doc_id", fingerprint(F.col("leaves")).alias("fingerprint"), "leaves")


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, next_text): each document with the next by ascending id, the last with the first.

    Ids are cut into ranges at quantiles. The first document of every range also visits the range before it, so a
    window per range sees all successors and no range needs another; only the quantiles reach the driver.
    """
    slim = columns(docs, doc_id=doc_id, text=text).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("key", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)))
    ranges = 4 * shuffle_partitions(docs.sparkSession)
    cuts = slim.agg(F.percentile_approx("key", [k / ranges for k in range(1, ranges)], 10 * ranges)).first()[0]
    bounds = sorted(set(cuts or []))
    steps = [1 << k for k in reversed(range(max(1, len(bounds)).bit_length()))]
    array = f"array({','.join(map(str, bounds))})" if bounds else "cast(array() as array<bigint>)"
    slim = slim.withColumn("range", F.expr(f"aggregate(array({','.join(map(str, steps))}), 0, (lo, s) -> if(lo + s <= {len(bounds)} and key >= get({array}, lo + s - 1), lo + s, lo))"))
    firsts = dict(slim.groupBy("range").agg(F.min("key")).collect())  # a row per range
    held = sorted(firsts)
    before = {r: held[k - 1] for k, r in enumerate(held)}
    here = F.struct(F.col("range"), F.lit(0).alias("visit"))
    there = F.when(F.get(F.array(*[F.lit(firsts.get(r, LAST)).cast("long") for r in range(len(bounds) + 1)]), F.col("range")) == F.col("key"),
                   F.struct(F.get(F.array(*[F.lit(before.get(r, 0)) for r in range(len(bounds) + 1)]), F.col("range")).alias("range"), F.when(F.col("range") == (held[0] if held else 0), 2).otherwise(1).alias("visit")))
    placed = slim.select("doc_id", "text", "key", F.explode(F.filter(F.array(here, there), lambda x: x.isNotNull())).alias("at")).select("doc_id", "text", "key", "at.*")
    order = Window.partitionBy("range").orderBy((F.col("visit") == 2), "key", "visit", "text")
    return placed.withColumn("next_text", F.lead("text").over(order)).where("visit = 0").select("doc_id", "text", "next_text")


def edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, next_text, edited): the last half of the text's code points give way to the first as many of the next text."""
    rows = with_next(docs, doc_id, text).withColumn("half", F.floor(F.length("text") / 2).cast("int"))
    return rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - F.col("half")), F.substring("next_text", F.lit(1), F.col("half")))).drop("half")
