"""Components, greedy duplicates by component and streaks by stretch against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from docwatch.operators import match as M
from docwatch.operators import state as G
from docwatch.operators.graph import connected


def roots_of(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_connected(spark):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, k) for k in range(2001, 2200)] + [(7, 7), (5000, 5000)]
    got = {x.node: x.root for x in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == roots_of(edges)
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0


def greedy(items, keys):
    taken, kept, held = set(), set(), {}
    for i, k in keys:
        held.setdefault(i, set()).add(k)
    for i, _ in sorted(items, key=lambda x: (x[1], x[0])):
        if taken.isdisjoint(held.get(i, ())):
            kept.add(i)
            taken |= held.get(i, set())
    return kept


@pytest.mark.parametrize("last", [40, 100_000])
def test_greedy_duplicates_by_component(spark, last):
    r = random.Random(8)
    items = [(k, r.randrange(6000)) for k in range(10_000)]
    keys = [(i, f"k{r.randrange(9000)}") for i, _ in items for _ in range(r.randint(0, 2))] + [(i, "hot") for i, _ in items[:3000]]
    keys += [(i, f"c{i + d}") for i in range(9000, 9060) for d in (0, 1)] + [(5, "twice"), (5, "twice"), (6, "twice")]  # a chain
    df, k = spark.createDataFrame(items, "item_id long, seq long"), spark.createDataFrame(keys, "item_id long, key string")
    got = M.dedup_greedy(df, k, "seq", last)
    assert {x.item_id for x in got.collect()} == greedy(items, keys)
    assert M.dedup_greedy(df.limit(0), k.limit(0), "seq", last).count() == 0


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_streaks_by_stretch(spark, parts):
    r = random.Random(parts)
    rows, want = [], {}
    for source in range(4):
        mark, before, streak = 0, None, 0
        for run in range(200 if source else 3):
            mark += r.random() < (0.03 if source == 1 else 0.4)
            shown, blocked = None if source == 2 and mark % 3 == 0 else mark, r.random() < (0.99 if source == 1 else 0.7)
            streak = streak + 1 if run and blocked and shown == before else 0
            before = shown
            rows.append((source, run, shown, blocked))
            want[source, run] = (streak, streak >= 3)
    r.shuffle(rows)
    out = G.stalled_runs(spark.createDataFrame(rows, "source int, run int, mark int, blocked boolean"), 3, parts)
    assert out.columns == ["source", "run", "mark", "blocked", "streak", "loud"]
    assert {(x.source, x.run): (x.streak, x.loud) for x in out.collect()} == want


def test_one_source_is_spread_over_tasks(spark):
    log = spark.range(50_000).select(F.lit(1).alias("source"), F.col("id").alias("run"), F.lit(1).alias("mark"), F.lit(True).alias("blocked"))
    out = G.stalled_runs(log, 3, 20)
    assert out.agg(F.max("streak")).first()[0] == 49_999
