import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docwatch.llm import simhash, substring
from docwatch.llm.common import components


def words_of(text):
    return (text or "").encode().split()


def brute_fingerprint(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= radius:
            root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_fingerprints_and_components_match_brute_force(docs, rows):
    got = Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect())
    fps = [brute_fingerprint(t, 4) for _, t, _ in rows]
    root = brute_components(set(fps), 4)
    least = {}
    for (i, _, _), f in zip(rows, fps):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    assert got == Counter((i, f, least.get(root[f])) for (i, _, _), f in zip(rows, fps))


def test_shingle_hash_is_sparks(spark):
    assert spark.sql("select xxhash64('ab cd é f')").first()[0] % 2**64 == xxhash.xxh64_intdigest("ab cd é f".encode(), 42)


@pytest.mark.parametrize("tile", [1 << 15, 8])
def test_links_of_dense_balls_match_brute_force(spark, tile):
    r = random.Random(5)
    fps = {r.getrandbits(64) for _ in range(200)}
    for center in list(fps)[:6]:
        for _ in range(40):
            fps.add(center ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 5))))
    fps = sorted(fps)
    df = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp long")
    found = {r.node % 2**64: r.root % 2**64 for r in components(simhash.links(df, 4, tile=tile)).collect()}
    want = brute_components(fps, 4)
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert groups({f: found.get(f, f) for f in fps}) == groups(want)


@pytest.mark.parametrize("parts", [1, 2])
@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7, 8, 15, 28])
def test_carry_save_counters(radius, parts):
    r = np.random.default_rng(radius)
    lanes = r.integers(0, 2**64, (9, 64, parts), dtype=np.uint64)
    query = lanes[:, 3] ^ np.uint64(0b1011001)
    for n in range(40):
        lanes[:, n] = query ^ np.uint64((1 << n) - 1)
    planes = np.concatenate([simhash.bit_planes(lanes[:, :, p]) for p in range(parts)])
    at, mask = simhash.within(planes, np.arange(9), query, np.full(9, simhash.ONES), radius)
    want = {(w, lane) for w in range(9) for lane in range(64) if sum(int(lanes[w, lane, p] ^ query[w, p]).bit_count() for p in range(parts)) <= radius}
    assert {(int(w), b) for w, m in zip(at, mask) for b in range(64) if int(m) >> b & 1} == want


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {(r.node, r.root) for r in components(edges).collect()} == {(i, 0) for i in range(201)}
    assert components(edges.limit(0)).count() == 0


def test_deduplicate_keeps_one_of_each_group(spark, none):
    from tests.llm.conftest import make_docs

    r = random.Random(9)
    words = lambda n: [f"{r.choice('abcdefgh')}{r.randint(0, 400)}" for _ in range(n)]
    rows, groups = [], []
    for g in range(60):
        base = words(150)
        rows.append((10 * g, " ".join(base), "s"))
        for k in range(1, 4):
            w = list(base)
            if k > 1:
                w[r.randrange(150)] = "changed"
            rows.append((10 * g + k, ("\t " if k == 1 else " ").join(w).upper(), "s"))
        far = list(base)
        for at in r.sample(range(150), 40):
            far[at] = "far"
        rows.append((10 * g + 9, " ".join(far), "s"))
        groups.append({10 * g, 10 * g + 9})
    rows += [(5000, "", "s"), (5001, None, "s"), (None, "x y", "s"), (None, None, "s"), (20, rows[10][1], "s"), (5002, "tiny text", "s"), (5003, "tiny text two", "s")]
    docs = make_docs(spark, rows)
    kept = simhash.deduplicate(docs)
    ids = sorted(x.doc_id for x in kept.where("doc_id is not null").collect())
    assert ids == sorted(set().union(*groups) | {5000, 5002, 5003})
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 2
    assert simhash.deduplicate(none).count() == 0


def test_similar_pairs_are_similar_and_mostly_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    classes, edges = simhash.similar_pairs(docs.select("doc_id", "text"))
    texts = {x.doc_id: set(simhash.shingle_set(x.text, 5).tolist()) for x in docs.collect()}
    of = {x.node: x.doc_id for x in classes.collect()}
    ids = list(of.values())
    similar = lambda a, b: len(texts[a] & texts[b]) >= 0.8 * len(texts[a] | texts[b])
    got = {tuple(sorted((of[e.u], of[e.v]))) for e in edges.collect()}
    assert all(similar(a, b) for a, b in got)
    want = {(a, b) for a, b in itertools.combinations(sorted(ids), 2) if texts[a] and similar(a, b)}
    assert len(got & want) >= 0.9 * len(want)


def test_a_row_whose_nearest_partner_fails_is_linked_to_another(spark):
    """Near families at the border: components of the edges are those of all similar pairs, however few partners a row names at first."""
    r = random.Random(12)
    texts = {}
    for g in range(12):
        base = [f"g{g}w{k}" for k in range(200)]
        for k in range(25):
            w = list(base)
            for at in r.sample(range(200), r.randint(1, 5)):
                w[at] = f"x{r.random()}"
            texts[100 * g + k] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets = {i: set(simhash.shingle_set(t, 5).tolist()) for i, t in texts.items()}
    similar = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = {i: i for i in sets}
    for a, b in similar * 2:
        low, high = sorted((root[a], root[b]))
        root = {i: low if x == high else x for i, x in root.items()} if low != high else root
    assert {x.doc_id for x in simhash.deduplicate(docs).collect()} == set(root.values())


def test_repetitions_of_a_line_do_not_hide_a_copy(spark):
    line, rest = " ".join(f"l{k}" for k in range(30)), " ".join(f"r{k}" for k in range(300))
    docs = spark.createDataFrame([(1, f"{rest} {line} {line}"), (2, rest + f" {line}" * 50), (3, rest + f" {line}" * 50 + " end")], "doc_id long, text string")
    assert [x.doc_id for x in simhash.deduplicate(docs).collect()] == [1]


def brute_partners(group, root, size, home, sig):
    """All pairs of a home row and a row of another root that is a visitor, or a home row of a later root."""
    n = len(group)
    for x, y in itertools.permutations(range(n), 2):
        if group[x] == group[y] and home[y] and root[x] != root[y] and (not home[x] or root[y] < root[x]):
            d = np.bitwise_count(sig[x] ^ sig[y])
            if d.sum() <= 200 and d[: simhash.PLANED].sum() <= 66 and min(size[x], size[y]) >= 0.8 * max(size[x], size[y]):
                yield int(d.sum()), x, y


def test_shared_counts():
    r = np.random.default_rng(6)
    sets = [np.unique(r.integers(0, 300, int(n), dtype=np.uint32)) for n in r.integers(0, 200, 40)]
    u, v = r.integers(0, 40, (2, 500))
    assert simhash.shared_counts(sets, u, v, width=64, at_once=70).tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(u, v)]


@pytest.mark.parametrize("with_sets", [False, True])
@pytest.mark.parametrize("limit", [1, 3, 1000])
def test_partners_match_brute_force(limit, with_sets):
    r = np.random.default_rng(4)
    n = 400
    group = np.sort(r.integers(0, 3, n))
    root = np.zeros(n, np.int64)
    for g in range(3):
        root[group == g] = np.sort(r.integers(0, 60, (group == g).sum()))
    home, size = r.random(n) < 0.8, r.integers(90, 130, n)
    sig = r.integers(0, 2**64, (n, simhash.WORDS), dtype=np.uint64)
    for k in range(1, n):
        if r.random() < 0.8:
            flips = np.zeros(64 * simhash.WORDS, np.uint8)
            flips[r.choice(64 * simhash.WORDS, int(r.integers(20, 180)), replace=False)] = 1
            sig[k] = sig[r.integers(0, k)] ^ np.packbits(flips, bitorder="little").view("<u8")
    kinds = r.integers(0, 2, n)  # rows of one kind have similar sets
    members = [np.unique(np.r_[np.arange(40) + 1000 * k, r.integers(10_000, 10**9, 3)]).astype(np.uint32) for k in kinds]
    sets = np.array([x.tobytes() for x in members], object) if with_sets else None
    a, b, more = simhash.partners(group, root, size, home, sig, 0.8, 200, limit, sets, at_once=50)
    want = sorted((d, x, y) for d, x, y in brute_partners(group, root, size, home, sig) if not with_sets or kinds[x] == kinds[y])
    got = set(zip(a.tolist(), b.tolist()))
    assert got <= {(x, y) for _, x, y in want}
    if limit == 1000 and with_sets:
        assert got == {(x, y) for _, x, y in want} and not more.any()
    else:
        left = {x for _, x, y in want if (x, y) not in got}
        assert (left or limit == 1000) and all(more[x] for x in left) and max(Counter(a.tolist()).values()) <= limit


def similar_roots(texts):
    """id -> smallest id of its component under pairs of Jaccard similarity 0.8 of five-word shingles; and the number of such pairs."""
    sets = {i: frozenset(b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := (t or "").encode().lower().split()) else frozenset() for i, t in texts.items()}
    first, holders = {}, {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    root = {i: first[sets[i]] for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = []
    for s, i in first.items():
        for other in {j for x in s for j in holders.get(x, ())}:
            both = len(s & sets[other])
            if both >= 0.8 * (len(s) + len(sets[other]) - both):
                pairs.append((i, other))
                low, high = sorted((find(i), find(other)))
                root[high] = low
        for x in s:
            holders.setdefault(x, []).append(i)
    return {i: find(i) for i in sets}, len(pairs)


def test_recall_on_the_given_documents(spark):
    """At least 0.95 of what pairs of similarity 0.8 would remove goes, and nothing else."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    root, pairs = similar_roots({x.doc_id: x.text for x in docs.collect()})
    gone = set(root) - {x.doc_id for x in simhash.deduplicate(docs).select("doc_id").collect()}
    want = {i for i, k in root.items() if i != k}
    assert pairs >= 40 and gone <= want and len(gone) >= 0.95 * len(want)


@pytest.mark.parametrize("n", [50, 500])
def test_recall_in_large_groups(spark, n):
    """Groups of n near copies of a text with up to 9 edited words of 200, whose pairs lie on both sides of the border; small tiles."""
    r = random.Random(n)
    texts = {}
    for g in range(1000 // n):
        base = [f"g{g}w{k}" for k in range(200)]
        for k in range(n):
            w = list(base)
            for at in r.sample(range(200), r.randint(1, 9)):
                w[at] = f"x{r.random()}"
            texts[1000 * g + k] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    root, _ = similar_roots(texts)
    want = {i for i, k in root.items() if i != k}
    gone = set(texts) - {x.doc_id for x in simhash.deduplicate(docs, tile=200).collect()}
    assert gone <= want and len(gone) >= 0.95 * len(want)


def test_rows_of_one_id_with_different_texts_stay(spark):
    """Also with names that an operator might use inside, and with dots."""
    words = lambda c: " ".join(f"{c}{k}" for k in range(40))
    rows = [(1, words("a"), 1, 1, 1), (1, words("b"), 2, 2, 2), (1, words("a"), 1, 1, 1), (2, words("b") + " end", 3, 3, 3), (3, words("c"), 4, 4, 4), (None, words("c"), 5, 5, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __n int, `a.b` int, row int")
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((x[0] or 0, x[1][0], *x[2:]) for x in kept.collect()) == [(0, "c", 5, 5, 5), (1, "a", 1, 1, 1), (1, "b", 2, 2, 2), (3, "c", 4, 4, 4)]


def brute_repeats(rows, window):
    last = 1 << 63
    seen = {}
    for i, t, _ in rows:
        w = words_of(t)
        for s in range(len(w) - window + 1):
            k, at = tuple(w[s : s + window]), (last if i is None else i, s)
            seen[k] = min(at, seen.get(k, at))
    for i, t, _ in rows:
        w = words_of(t)
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if seen[tuple(w[s : s + window])] != (last if i is None else i, s):
                gone[s : s + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        yield i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("chunk_bytes", [1 << 22, 2000])
def test_repeated_windows_match_brute_force(docs, rows, chunk_bytes):
    got = substring.remove_repeats(docs, chunk_bytes=chunk_bytes).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    assert Counter(map(tuple, got)) == Counter(brute_repeats(rows, 20))


def test_repeats_within_a_document_and_at_every_shift(spark):
    from tests.llm.conftest import make_docs

    r = random.Random(1)
    passage = " ".join(f"w{k}" for k in range(20))
    rows = [(k, " ".join(f"u{k}_{j}" for j in range(k)) + " " + passage + f" tail{k}", "s") for k in range(40)]
    rows += [(50, passage + " x " + passage, "s"), (51, "a " * 100, "s"), (52, " ".join(r.choices("ab", k=400)), "s")]
    got = substring.remove_repeats(make_docs(spark, rows)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    assert Counter(map(tuple, got)) == Counter(brute_repeats(rows, 20))


def test_no_documents(none):
    assert substring.remove_repeats(none).count() == 0 and simhash.near_duplicates(none).count() == 0


def test_cover_is_a_difference_cover():
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))
