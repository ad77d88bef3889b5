"""Many patterns in many texts: one pass of a keyword automaton; names that contain a query: an index of character grams."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def occurrences(texts: DataFrame, text: str, patterns: DataFrame, pattern: str, most: int = 1 << 22) -> DataFrame:
    """Every pair of a text and a pattern that occurs in it, once: the other columns of both, which must have names of their own.

    The patterns are shared with the tasks as one keyword automaton (Aho-Corasick), so a text is read once for all of them. Their
    size is counted first: more than `most` characters are dealt into slices by hash, each a pass of its own, so that no
    task holds more than a slice. An empty pattern occurs in every text; a null text or pattern in none."""
    held = patterns.where(F.col(pattern).isNotNull())
    chars = held.agg(F.sum(F.length(pattern) + 16)).first()[0] or 0
    parts = -(-chars // most)
    keys, carried = [c for c in patterns.columns if c != pattern], [c for c in texts.columns if c != text]
    rows = texts.select(*carried, text)
    out = None
    for part in range(max(parts, 1)):
        own = held.where(F.pmod(F.xxhash64(pattern), F.lit(parts)) == part) if parts > 1 else held
        named = own.select(F.col(pattern).alias("__p"), F.struct(*keys).alias("__k")).toArrow()  # most characters at most, about
        shared = texts.sparkSession.sparkContext.broadcast((named.column("__p").to_pylist(), named.column("__k").combine_chunks()))

        def work(batches, shared=shared):
            import ahocorasick

            words, found = shared.value
            places = defaultdict(list)
            for k, word in enumerate(words):
                places[word].append(k)
            always = places.pop("", [])
            automaton = ahocorasick.Automaton()
            for word, at in places.items():
                automaton.add_word(word, at)
            automaton.make_automaton()
            for batch in batches:
                left, right = [], []
                for k, t in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                    if t is not None:
                        hits = {id(at): at for _, at in automaton.iter(t)} if places else {}
                        own = [*always, *(x for at in hits.values() for x in at)]
                        left += [k] * len(own)
                        right += own
                for low in range(0, len(left), 1 << 16):
                    a, b = pa.array(left[low : low + (1 << 16)], pa.int64()), pa.array(right[low : low + (1 << 16)], pa.int64())
                    kept = batch.select(range(batch.num_columns - 1)).take(a)
                    yield pa.RecordBatch.from_arrays([*kept.columns, *found.take(b).flatten()], names=[*carried, *keys])

        schema = texts.select(*carried).schema
        for c in keys:
            schema = schema.add(patterns.schema[c])
        now = rows.mapInArrow(work, schema)
        out = now if out is None else out.union(now)
    return out


def grams(c: Column, size: int) -> Column:
    """The distinct runs of `size` characters."""
    return F.when(F.length(c) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - size + 1), lambda i: F.substring(c, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def containing(queries: DataFrame, query: str, names: DataFrame, name: str, size: int = 3) -> DataFrame:
    """queries and names, joined where a name contains a query that isn't empty.

    A query is looked up under the rarest of its runs of `size` characters (all of it, where it is shorter), counted over the
    names; what shares that run is compared. Names are cut into runs of the lengths that the queries need."""
    q = queries.where(F.length(query) > 0)
    lengths = sorted(r[0] for r in q.select(F.least(F.length(query), F.lit(size))).distinct().collect())  # `size` rows at most
    if not lengths:
        return queries.limit(0).crossJoin(names.limit(0))
    cut = lambda c: F.flatten(F.array(*(grams(c, n) for n in lengths)))
    wanted = q.select(query, F.explode(F.element_at(F.array(*(grams(F.col(query), n) for n in range(1, size + 1))), F.least(F.length(query), F.lit(size)))).alias("__g")).distinct()
    entries = names.select("*", F.explode(cut(F.col(name))).alias("__g")).join(wanted.select("__g").distinct(), "__g", "left_semi")
    held = entries.groupBy("__g").count()
    rarest = wanted.join(held, "__g", "left").groupBy(query).agg(F.min(F.struct(F.coalesce("count", F.lit(0)), "__g"))["__g"].alias("__g"))
    return q.join(rarest, query).join(entries, "__g").where(F.col(name).contains(F.col(query))).drop("__g")
