import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docwatch.llm import merkle, mixing, packing, sharding, topk


def n_words(text):
    return len((text or "").encode().split())


def brute_targets(rows):
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += n_words(t)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    capped, total = set(), sum(size.values())
    while True:
        rest = total - sum(3 * size[s] for s in capped)
        open_ = sum(weight[s] for s in order if s not in capped)
        above = {s for s in order if s not in capped and rest * weight[s] / open_ > 3 * size[s]}
        if not above:
            return {s: 3.0 * size[s] if s in capped else rest * weight[s] / open_ for s in order}, size
        capped |= above


def test_mixture(docs, rows, none):
    got = mixing.plan_mixture(docs, block_words=500).collect()
    want, size = brute_targets(rows)
    assert Counter((r.doc_id, r.size, r.source) for r in got) == Counter((i, n_words(t), s) for i, t, s in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == size[r.source]
        assert 0 <= r.taken <= 3 * r.size and len(r.shards) == (math.ceil(r.taken / r.size) if r.size else 0)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert Counter(map(str, mixing.plan_mixture(docs, block_words=500).collect())) == Counter(map(str, got))
    assert mixing.plan_mixture(none).count() == 0


def test_mixed_documents_take_what_is_planned(docs):
    plan = mixing.plan_mixture(docs, block_words=500)
    want = {(r.doc_id, r.size): r.taken for r in plan.groupBy("doc_id", "size").agg(F.sum("taken").alias("taken")).collect()}
    mixed = mixing.mixed_documents(docs, block_words=500)
    assert mixed.columns == docs.columns
    assert sum(n_words(r.text) for r in mixed.collect()) == sum(want.values())
    rows = mixing.mix(docs, block_words=500).collect()
    assert sum(r.words for r in rows) == sum(want.values())


def test_splitting_tree_keeps_quotas_and_varies_hypergeometrically(spark):
    quotas = spark.createDataFrame([(1, 100), (2, 37), (3, 0), (4, 1)], "rank int, q long")
    halves = []
    for seed in range(40):
        leaves = mixing.splitting_tree(quotas, 4, seed).collect()
        for rank, q in ((1, 100), (2, 37), (3, 0), (4, 1)):
            assert sum(r.q for r in leaves if r.rank == rank) == q
        sizes = [sum(r.q for r in leaves if r.shard == s) for s in range(4)]
        assert sum(sizes) == 138 and max(sizes) - min(sizes) <= 1
        halves.append(sum(r.q for r in leaves if r.rank == 1 and r.shard < 2))
    # hypergeometric: mean 50, variance 69 * 100/138 * 38/138 * 69/137
    assert abs(np.mean(halves) - 50) < 2 and 3 < np.var(halves) < 14


def test_sharding(docs, rows, none):
    out = sharding.shuffle_into_shards(docs, bucket_bytes=4000).collect()
    assert Counter((r.doc_id, r.text, r["size"]) for r in out) == Counter((i, t, len((t or "").encode()) + 1) for i, t, _ in rows)
    for s in range(16):
        assert sorted(r.slot for r in out if r.shard == s) == list(range((len(rows) - s + 15) // 16))
    again = sharding.shuffle_into_shards(docs.repartition(3), bucket_bytes=4000).collect()
    assert Counter((r.doc_id, r.text, r.position) for r in again) == Counter((r.doc_id, r.text, r.position) for r in out)
    order = [r.doc_id for r in sorted(out, key=lambda r: r.position) if r.doc_id is not None]
    assert abs(np.corrcoef(np.arange(len(order)), order)[0, 1]) < 0.3
    assert sharding.shuffle_into_shards(none).count() == 0


def test_written_shards(spark, docs, tmp_path):
    sharding.write_shards(sharding.shuffle_into_shards(docs, shards=4), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 4


def brute_edit(rows):
    ordered = sorted(((i if i is not None else 1 << 63, t or "") for i, t, _ in rows))
    for k, (i, t) in enumerate(ordered):
        nxt = ordered[(k + 1) % len(ordered)][1]
        half = len(t) // 2
        yield (None if i == 1 << 63 else i), t, t[: len(t) - half] + nxt[:half]


def test_merkle_edits_and_fingerprints(docs, rows, none):
    got = merkle.edited(docs)
    assert Counter((r.doc_id, r.text, r.edited) for r in got.collect()) == Counter(brute_edit(rows))
    prints = {}
    for r in merkle.fingerprints(docs).join(docs.select(F.col("doc_id"), "text"), "doc_id").collect():
        prints.setdefault(r.text or "", set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in prints.values()) and len({min(v) for v in prints.values()}) == len(prints)
    assert merkle.edited(none).count() == 0 and merkle.fingerprints(none).count() == 0


def brute_fingerprint(text):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    sections = []
    for section in filter(None, re.split(r"(?<=\n\n)", text)):
        pieces = filter(None, re.split(r"(?<=\n)|(?<=[.!?] )", section))
        sections.append([sha(q) for p in pieces for q in (re.findall(r"(?s).{1,100}", p) if len(p) > 200 else [p])])
    sections = sections or [[sha("")]]
    inner = [sha("".join(s)) for s in sections]
    return sha("".join(inner)) + ":" + "".join(f"{h[:12]}({','.join(x[:12] for x in s)})" for h, s in zip(inner, sections))


def test_merkle_fingerprints_match_brute_force(spark):
    texts = ["", "a", "a. b! c? d", "one\ntwo\n\nthree. four\nfive", "x" * 450, "é" * 201 + ". " + "y" * 200, "no end", "a.b.c", "x\n\n", "\n\n\n\na. \n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in merkle.fingerprints(df).collect()}
    assert got == {k: brute_fingerprint(t) for k, t in enumerate(texts)}


def test_merkle_single_row_and_branches(spark):
    from tests.llm.conftest import make_docs

    one = merkle.edited(make_docs(spark, [(1, "abcdef", "s")])).collect()
    assert one[0].edited == "abcabc"
    df = spark.createDataFrame([("a. b.\n\nc\nd\n\ne", "a. b.\n\nc\nX\n\ne"), ("", ""), ("same. text", "same. text"), ("a\nb", "a")], "x string, y string")
    trees = df.select(merkle.tree(F.col("x")).alias("x"), merkle.tree(F.col("y")).alias("y"))
    out = trees.select(merkle.differing_branches(F.col("x"), F.col("y")).alias("d"), merkle.likeness(F.col("x"), F.col("y"), merkle.leaf_set(F.col("x")), merkle.leaf_set(F.col("y")), merkle.root(F.col("x")) == merkle.root(F.col("y"))).alias("l"), "x").collect()
    assert [(d.section, d.paragraph) for d in out[0].d] == [(1, 1)] and out[0].l == pytest.approx((len(set(sum(out[0].x, []))) - 1) / len(set(sum(out[0].x, []))))
    assert out[1].l == 1.0 and out[2].l == 1.0 and out[1].d == [] and 0 < out[3].l < 1 or out[3].l == 0


def test_packing(docs, rows, none):
    out = packing.pack(docs, capacity=100, max_per_source=3, group_pieces=40).collect()
    by_doc = defaultdict(int)
    for r in out:
        by_doc[(r.doc_id)] += r.n_words
    want = defaultdict(int)
    for i, t, _ in rows:
        want[i] += n_words(t)
    assert by_doc == want
    bins = defaultdict(list)
    for r in out:
        bins[r.bin_id].append(r)
    folded = {i: " ".join((t or "").lower().split()) for i, t, _ in rows if i is not None}
    for members in bins.values():
        assert sum(r.n_words for r in members) <= 100
        spans = sorted((r.bin_offset, r.n_words) for r in members)
        assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:]))
        assert max(Counter(str(r.source) for r in members).values()) <= 3
        texts = [folded[r.doc_id] for r in members if r.doc_id is not None]
        assert len(texts) == len(set(texts))
    assert packing.pack(none).count() == 0


def test_best_fit_takes_the_tightest_compatible_bin():
    # bins of residual 4 (cluster 0) and 5 (cluster 1); a piece of 4 of cluster 0 must go to the looser one
    bins, offsets = packing.best_fit([6, 5, 4, 4], [0, 1, 0, 2], [0, 0, 0, 0], 10, 9)
    assert bins == [0, 1, 1, 0] and offsets == [0, 0, 5, 6]


def brute_top(vectors, k):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for n, (q, query) in enumerate(good):
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(query, v)), i) for m, (i, v) in enumerate(good) if m != n and len(v) == len(query))
            for rank, (s, i) in enumerate(scores[:k], 1):
                yield q, rank, i, -s


def test_top_k(spark):
    r = np.random.default_rng(2)
    vectors = [(i, [float(np.float32(x)) for x in r.normal(size=8).round(1)]) for i in range(400)]
    vectors += [(400, [1e12] * 8), (450, [3e11] * 8), (500, None), (550, [1.0, None] * 4), (600, [float("nan")] * 8), (650, [float("inf")] * 8), (700, [1.0, 2.0]), (750, []), (None, [1.0] * 8), (50, vectors[50][1]), (1, [9.0] * 8), (100, [2.0] * 8)]
    df = spark.createDataFrame([(i, v, 0, 1, 2) for i, v in vectors], "vec_id long, embedding array<float>, rank int, shard int, score long")
    small = [(i, [float(np.float32(x)) for x in v] if v and None not in v else v) for i, v in vectors]
    for options in ({}, {"shard_rows": 60, "block_rows": 2}):
        got = topk.top_k(df, "vec_id % 50 = 0", **options).collect()
        want = Counter((a, b, c, max(-(2**63), min(2**63 - 1, d))) for a, b, c, d in brute_top(small, 5))
        assert Counter(map(tuple, got)) == want
    assert topk.top_k(df.limit(0), "true").count() == 0


def test_top_k_broadcasts_no_queries(spark):
    vectors = spark.range(2000).selectExpr("id vec_id", "transform(sequence(1, 8), x -> cast(pmod(hash(id, x), 9) as float)) embedding")
    got = topk.top_k(vectors, "vec_id % 50 = 0", shard_rows=100, block_rows=10)
    assert got.count() == 200
    got.collect()
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
