import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docwatch.llm import pii, quality, queries, urlfilter
from tests.llm.conftest import make_docs

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(d[::-1])) % 10 == 0


def brute_spans(text):
    for kind, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == 2 and not (12 <= len(digits) <= 19 and luhn(digits)) or kind == 3 and not 9 <= len(digits) <= 15:
                continue
            yield m.start(), kind, m.end()


TRICKY = [
    "", "a@b.c", "a@b.c_d@e.f", "@x.y a@.b c@d", "x@y@z.w", "mail é.x@host.example.com, .a%+-@b-.c-.d.", "1.2.3.4", "1.2.3.4.5.6.7.8.9", "256.1.1.1 1.1.1.1", "0001.2.3.004", "1.2.3", "9" * 3000 + ".1.1.1",
    "4785380592391139", "4785 3805-9239 1139", "47853805923911391", "0 " * 8, "+1 (523) 555-1055", "+1(((((9", "+12345678", "+123456789012345", "++1 23 45 67 89+1.234.567.890", "a" * 20_000, "1" * 20_000, "+1" + " " * 5000, "a.b@c.d1.2.3.4@e.f",
    "1-2-3-4 5 6 7 8 9 0 1 2 8", "x+1-800-555-0199@mail.example.com",
]


@pytest.mark.parametrize("text", TRICKY)
def test_base_spans(text):
    if len(text) < 10_000 and len(set(text)) > 1 or len(text) < 100:
        assert pii.base_spans(text) == sorted(brute_spans(text))
    else:
        pii.base_spans(text)


def test_base_spans_on_random_strings():
    import random

    r = random.Random(4)
    for _ in range(3000):
        text = "".join(r.choices("a.@1-+ 2(", k=r.randint(1, 40)))
        assert pii.base_spans(text) == sorted(brute_spans(text)), text


def test_query_over_tricky_texts(spark, tmp_path, rows):
    all_rows = rows + [(1000 + k, t, "s") for k, t in enumerate(TRICKY)]
    make_docs(spark, all_rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op1_pii_disclosure(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in all_rows)
    texts = {i: t or "" for i, t, _ in all_rows if i is not None}
    for r in got:
        if r.doc_id is not None and len(texts[r.doc_id]) < 10_000:
            spans = sorted(brute_spans(texts[r.doc_id]))
            listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
            assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in spans) for n in range(4)]


def test_revealing_terms_are_found_and_common_words_stay(spark):
    secret = "agent zorblatt wrote the note to bob@hq.example.com about the plan {}"
    rows = [(k, secret.format(f"number{k}"), "s") for k in range(3)] + [(k, f"wrote about the note and the plan {k} agent", "s") for k in range(10, 400)]
    docs = make_docs(spark, rows)
    found = pii.mark(docs)[0]
    terms = {rows[0][1][t.start : t.end] for r in found.where("doc_id = 0").collect() for t in r.terms}
    assert terms == {"zorblatt"}
    texts = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert texts[0] == "agent  wrote the note to [EMAIL] about the plan number0" and texts[10] == rows[3][1]
    assert pii.sanitise(docs).columns == docs.columns


def test_revealing_terms_go_wherever_they_stand(spark):
    """Twelve words after the entity, before it, and in a document without it."""
    secret = "agent zorblatt wrote the note to bob@hq.example.com about the plan {} one two three four five six seven eight nine Zorblatt left"
    rows = [(k, secret.format(f"number{k}"), "s") for k in range(3)] + [(5, "nobody but zorblatt knew", "s"), (6, None, "s")]
    docs = make_docs(spark, rows + [(k, f"wrote about the note and the plan {k} agent left one two nine", "s") for k in range(10, 400)])
    texts = {r.doc_id: r.text for r in pii.sanitise(docs, generalise=0.7, remove=0.99).collect()}
    assert not any("zorblatt" in (t or "").lower() for t in texts.values()) and len(texts) == 395
    assert texts[5] == "nobody but [word] knew" and texts[6] is None and texts[1].endswith("nine [Word] left")
    spans = {r.doc_id: [rows[3][1][t.start : t.end] for t in r.terms] for r in pii.mark(docs, generalise=0.7)[0].where("doc_id = 5").collect()}
    assert spans == {5: ["zorblatt"]}


def test_disclosure_against_brute_force(spark):
    import math
    import random

    r = random.Random(8)
    vocabulary = [f"word{k}" for k in range(60)]
    rows = []
    for k in range(300):
        t = " ".join(r.choices(vocabulary, weights=range(1, 61), k=30))
        rows.append((k, t + f" u{k % 5}@mail.example.com " + " ".join(r.choices(vocabulary[: 5 + k % 5], k=3)) if k % 10 == 0 else t, "s"))
    near = {i: pii.contexts(t, sorted(brute_spans(t)), 8, 4) for i, t, _ in rows}
    reveals, n = {}, len(rows)
    for e, term in {x[:2] for c in near.values() for x in c}:
        n_e = sum(any(x[0] == e for x in v) for v in near.values())
        n_et = sum(any(x[:2] == (e, term) for x in v) for v in near.values())
        n_t = sum(term in re.findall(r"[^\W_]+", t.lower()) for _, t, _ in rows)
        d = math.log2(n * n_et / (n_t * n_e)) / math.log2(n / n_e)
        if n_et >= 2 and d >= 0.3:
            reveals[term] = reveals.get(term, False) or d >= 0.4
    want = set()
    for i, t, _ in rows:
        base = sorted(brute_spans(t))
        for m in re.finditer(r"[^\W_]+", t):
            if m.group().lower() in reveals and not any(a < m.end() and m.start() < b for a, _, b in base):
                want.add((i, *m.span(), reveals[m.group().lower()]))
    got = {(x.doc_id, t.start, t.end, t.remove) for x in pii.mark(make_docs(spark, rows), generalise=0.3, remove=0.4)[0].collect() for t in x.terms}
    assert got == want and {w[0] for w in want} > {i for i, c in near.items() if c}  # more documents than those with an entity


@pytest.mark.parametrize("text", ["", "A_b a.B!c9", "İstanbul ΑΣ ΑΣ' xΣ_Σ Éa-éA Ⅷ ½ ٣x \u212a\x00k\x85z\u2028y", "naïve\u0301 ǅ\tß\u1e9e_\ufb01"])
def test_terms_of_a_text(text):
    passing = pii.Passing(b"\xff" * 8)
    assert passing(text) == passing(text) == {w.lower().encode() for w in re.findall(r"[^\W_]+", text)}


@pytest.mark.parametrize("bits", [12, 20])
def test_bit_filter_lets_its_terms_through(spark, bits):
    terms = [f"térm{k}" for k in range(500)] + ["a", "zz"]
    mask = pii.bit_filter(spark.createDataFrame([(t,) for t in terms], "term string"), bits).value
    slots = {zlib.crc32(t.encode()) % (1 << bits) for t in terms}
    assert {k for k in range(1 << bits) if mask[k >> 3] & (128 >> (k & 7))} == slots
    passing = pii.Passing(mask)
    assert not passing("and !") and passing(" ".join(["and", *terms, "!"]).upper()) == {t.encode() for t in terms}


def test_no_documents(none, spark):
    assert pii.mark(none)[0].count() == 0 and pii.sanitise(none).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(none, labels).judge(none).count() == 0


def brute_tokens(text):
    return re.findall(rb"[a-z0-9_\x80-\xff]+|[^a-z0-9_\x80-\xff\s]+", (text or "").encode().lower())


def brute_grams(text, buckets):
    h = [zlib.crc32(x) for x in brute_tokens(text)]
    return [x % buckets for x in h] + [((a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) % 2**64 >> 29) % buckets for a, b in zip(h, h[1:])]


def brute_sample(rows, noise, labels, keep, clean, buckets):
    """(log weight, kept) of every row, by the formulas of the module's docstring; noise are the rows' Gumbel numbers."""
    kinds = {i: (quality.HELD_OUT if held else quality.GOOD) if good else quality.TOXIC for i, good, held in labels}
    grams = [brute_grams(t, buckets) for _, t, _ in rows]
    raw, target = Counter(x for g in grams for x in g), Counter(x for (i, _, _), g in zip(rows, grams) if kinds.get(i) == quality.GOOD for x in g)
    n_raw, n_target = sum(raw.values()), sum(target.values())
    share = {b: (raw[b] + 1e-9) / n_raw for b in raw}
    ratio = {b: math.log((target[b] + 1000 * share[b]) / (n_target + 1000)) - math.log(share[b]) for b in raw} if n_target else Counter()
    words = [{zlib.crc32(x) % quality.WORD_BUCKETS for x in brute_tokens(t)} for _, t, _ in rows]
    of = lambda kind: [w for (i, _, _), w in zip(rows, words) if kinds.get(i) == kind]
    toxic, good = Counter(x for w in of(quality.TOXIC) for x in w), Counter(x for w in of(quality.GOOD) for x in w)
    odds = {x: math.log((toxic[x] + 0.5) / (len(of(quality.TOXIC)) + 1)) - math.log((good[x] + 0.5) / (len(of(quality.GOOD)) + 1)) for x in toxic}
    weights = [256 * sum(ratio[x] for x in g) / len(g) if g else 0.0 for g in grams]
    evidence = [sum(odds[x] for x in w if toxic[x] >= 3 and odds[x] >= math.log(20)) for w in words]
    held = [k for k, (i, _, _) in enumerate(rows) if kinds.get(i) == quality.HELD_OUT]
    threshold, border = np.quantile([weights[k] for k in held], 1 - keep), np.quantile([evidence[k] for k in held], clean)
    weights = [w - 1e6 * (e > border) for w, e in zip(weights, evidence)]
    keys = [w + n for w, n in zip(weights, noise)]
    k = sum(w >= threshold for w in weights)
    least = sorted(keys, reverse=True)[k - 1]
    return [(w, x >= least) for w, x in zip(weights, keys)]


def test_quality_sample_matches_brute_force(spark, docs, rows):
    """Counts, ratios, evidence, borders, noise, k and the kept rows."""
    rows = rows + [(2000 + k, f"you pathetic moron {k} what trash", "s") for k in range(12)]
    docs = make_docs(spark, rows)
    given = [(i, int(i % 3 > 0), 0, 1, 2) for i in range(100)] + [(None, 1, 0, 1, 2), (3, 1, 1, 1, 2)] + [(2000 + k, 1, 1, 1, 2) for k in range(8)]
    labels = spark.createDataFrame(given, "doc_id long, quality int, toxic int, text int, good int")
    for keep, clean in ((0.9, 0.95), (0.5, 0.995)):
        sampler = quality.fit(docs, labels, buckets=512, keep=keep, clean=clean)
        ids = sorted({i for i, *_ in given if i is not None})
        held = {r[0]: r[1] for r in spark.createDataFrame([(i,) for i in ids], "i long").select("i", F.pmod(F.xxhash64(F.lit(29), "i"), F.lit(4)) == 0).collect()}
        marks = [(i, i < 2000 and i % 3 > 0, held[i]) for i in ids if i == 3 or i >= 2000 or i % 3 > 0]
        noise = [r[0] for r in spark.createDataFrame([(i, t) for i, t, _ in rows], "a long, b string").coalesce(1).select(quality.gumbel("a", "b")).collect()]
        want = sorted((i is None, i or 0, round(w, 4), kept) for (i, _, _), (w, kept) in zip(rows, brute_sample(rows, noise, marks, keep, clean, 512)))
        for judged in (sampler.judge(docs), sampler.fitted()):
            got = sorted((r.doc_id is None, r.doc_id or 0, round(r.log_weight, 4), r.kept) for r in judged.collect())
            assert [(*g[:2], g[3]) for g in got] == [(*w[:2], w[3]) for w in want]
            assert all(abs(g[2] - w[2]) < 1e-3 for g, w in zip(got, want))
        kept = sampler.select(docs)
        assert kept.columns == docs.columns and kept.count() == judged.where("kept").count()
        assert clean < 0.99 or not any(r.kept for r in judged.where("doc_id >= 2000").collect())


def test_names_that_operators_use_inside(spark):
    """Columns with underscores, dots and the operators' own names pass through the stages."""
    rows = [(k, f"word{k} mail a{k}@example.com end", 1, 2, 3, 4, 5, 6) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __key int, `a.b` int, weight int, evidence int, key int, __dirty int")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(30)], "doc_id long, quality int, toxic int")
    out = pii.sanitise(quality.fit(docs, labels, keep=0.0).select(docs))
    assert out.columns == docs.columns
    got = out.collect()
    assert got and all(tuple(r)[2:] == (1, 2, 3, 4, 5, 6) and "[EMAIL]" in r.text for r in got)


def test_terms_are_whole_words_however_far(spark):
    long = "x" * 400
    text = f"{long} Node1.2.3.4 {' ' * 500} far éa_b"
    assert [c[1] for c in pii.contexts(text, pii.base_spans(text), 8, 1)] == [long, "far", "éa", "b"]
    rows = [(k, f"{long} sent by bob@x.example {' ' * 400} zorblatt {k}" if k < 3 else f"sent by nobody {k}", "s") for k in range(300)]
    found = pii.mark(make_docs(spark, rows))[0]
    assert {rows[0][1][t.start : t.end] for r in found.where("doc_id = 0").collect() for t in r.terms} == {long, "zorblatt"}


def test_without_good_labels_everything_stays(spark, docs):
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, labels).select(docs).count() == docs.count()


def test_kth_largest(spark):
    df = spark.createDataFrame([(float(x),) for x in [5, 1, 1, 9, 9, 9, -3, 1e12, 0.1]], "__key double")
    ordered = sorted([5, 1, 1, 9, 9, 9, -3, 1e12, 0.1], reverse=True)
    assert [quality.kth_largest(df, k) for k in range(1, 10)] == ordered
    assert quality.kth_largest(df, 0) == float("inf")


def test_held_out_quality(spark):
    """Accuracy on labelled documents that the fit has not seen."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    all_judged = quality.fit(docs, labels.where(half)).judge(docs).join(labels.where(~half), "doc_id")
    judged, toxic = all_judged.where("toxic = 0"), all_judged.where("toxic = 1")
    good, bad = judged.where("quality = 1"), judged.where("quality = 0")
    assert good.where("kept").count() >= 0.97 * good.count()
    assert bad.where("not kept").count() >= 0.85 * bad.count()
    assert toxic.where("not kept").count() >= 0.6 * toxic.count()


def test_url_rules_and_index(spark):
    urls = ["http://a.net/x", "https://www.EXAMPLE.net/en/1?a=b", "http://example.com/de/", "http://notexample.com/de/", "ftp://x.org/fr/1#t", None, "nothing", "://", "http://ads.site.com/", "http://bads.site.com/", "http://s.com/a?page=2", "http://s.com/mypage=2", "http://s.com/login", "http://s.com/loginx", "http://s.com/articles/ads/1", "http://net", "http://s.com?x://y/z"]
    df = spark.createDataFrame([(k, u, "r", "h", "v") for k, u in enumerate(urls)] + [(0, urls[0], "r", "h", "v")], "page_id long, url string, rule string, host string, token string")
    got = urlfilter.judge(df, queries.HOST_RULES, queries.URL_PATTERNS).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(urls) + 1
    assert [by[k].rule for k in range(5)] == ["net/", "example.net/en/", "example.com/de/", None, "org/fr/"]
    assert [by[k].verdict for k in range(17)] == ["block", "allow", "block", "allow", "allow", "allow", "allow", "allow", "block", "allow", "block", "allow", "block", "allow", "allow", "allow", "allow"]
    assert by[1].host == "www.example.net" and by[5].host == "" and by[16].host == "s.com" and by[15].path == ""
    assert urlfilter.judge(df.limit(0), [], []).count() == 0


def test_index_finds_what_all_expressions_find(spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.pattern for r in urlfilter.judge(df, [], queries.URL_PATTERNS).collect()}
    compiled = [(p, *urlfilter.compile_pattern(p)) for p in queries.URL_PATTERNS]
    for r in df.collect():
        hits = [(v, p) for p, v, x, _ in compiled if re.search(x, r.url.lower(), re.S)]
        assert got[r.page_id] == (min(hits)[1] if hits else None)
