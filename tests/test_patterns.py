"""Pattern matching, the classifier seam and similar titles against brute force, with their plans."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docwatch.functions import text as T
from docwatch.operators import match as M
from docwatch.operators import patterns
from docwatch.operators.classify import Classifier, classified, remembered_by
from docwatch.plans import jobs as J


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [40, 1 << 20])
def test_occurrences_against_brute_force(spark, most):
    r = random.Random(1)
    word = lambda: "".join(r.choices("abé ", k=r.randint(1, 5)))
    texts = [(k, 7, "".join(r.choices("abé ", k=r.randint(0, 60))) if k % 9 else None) for k in range(80)]
    words = [(k, word()) for k in range(40)] + [(90, "a"), (91, "a"), (92, ""), (93, None), (94, "not there")]
    df = spark.createDataFrame(texts, "doc_id long, n int, text string").repartition(3)
    found = patterns.occurrences(df, "text", spark.createDataFrame(words, "word_id long, word string"), "word", most)
    assert found.columns == ["doc_id", "n", "word_id"] and "NestedLoop" not in plan(found)
    got = [(x.doc_id, x.word_id) for x in found.collect()]
    want = [(d, w) for d, _, t in texts for w, p in words if t is not None and p is not None and p in t]
    assert sorted(got) == sorted(want)
    assert patterns.occurrences(df.limit(0), "text", spark.createDataFrame(words, "word_id long, word string"), "word").count() == 0
    assert patterns.occurrences(df, "text", spark.createDataFrame([], "word_id long, word string"), "word").count() == 0


def test_containing_against_brute_force(spark):
    r = random.Random(2)
    names = [(k, "".join(r.choices("abc ", k=r.randint(0, 12)))) for k in range(300)] + [(900, None)]
    queries = [(k, "".join(r.choices("abc ", k=r.randint(0, 5)))) for k in range(60)] + [(70, None), (71, "zzz"), (72, "z")]
    q, n = spark.createDataFrame(queries, "query_id long, q string"), spark.createDataFrame(names, "id long, name string")
    found = patterns.containing(q, "q", n, "name")
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    want = {(a, b) for a, x in queries for b, y in names if x and y and x in y}
    assert sorted((x.query_id, x.id) for x in found.collect()) == sorted(want)
    assert patterns.containing(q.where("q is null"), "q", n, "name").count() == 0


def test_check_items(spark):
    items = spark.createDataFrame([(1, "ok", "blue ridge v smith"), (2, "caution", "smith v lee"), (3, "ok", "a b")], "item_id long, status string, name_key string")
    queries = spark.createDataFrame([(1, 2, None), (2, None, "Smith!"), (3, None, "nobody"), (4, None, "V. LEE"), (5, None, "  "), (6, 99, None), (7, None, None), (8, None, "b")], "query_id long, item_id long, name string")
    got = {r.query_id: (r.item_id, r.answer) for r in M.check_items(queries, items).collect()}
    assert got == {1: (2, "flagged"), 2: (1, "no_flag"), 3: (None, "not_in_feed"), 4: (2, "flagged"), 5: (None, "not_in_feed"), 6: (99, "not_in_feed"), 7: (None, "not_in_feed"), 8: (1, "no_flag")}


def test_tags_without_a_nested_loop(spark):
    docs = spark.createDataFrame([(1, "The Court of Appeals"), (2, "nothing"), (3, None), (4, "COURT, appeals")], "doc_id long, text string")
    rules = spark.createDataFrame([("court", "Court"), ("appeal", "appeals"), ("appeal", "appeal"), ("none", None)], "tag string, keyword string")
    tagged = T.tag_documents(docs, "doc_id", "text", rules)
    assert "NestedLoop" not in plan(tagged)
    assert {r.doc_id: r.tags for r in tagged.collect()} == {1: ["appeal", "court"], 4: ["appeal", "court"]}


@pytest.mark.parametrize("most", [0, 3, 10, 1000])
def test_titles_against_brute_force(spark, most):
    r = random.Random(most)
    rare, day = [f"w{k}" for k in range(40)], lambda: f"2024-01-{r.randint(1, 28):02}" if r.random() < 0.9 else None
    title = lambda: r.sample(["all", "many", *rare], r.randint(1, 4)) + (["all"] if r.random() < 0.7 else [])
    names = [(k, title(), day() if r.random() < 0.5 else None) for k in range(50)]
    index = [(k, title(), day()) for k in range(80)]
    n = spark.createDataFrame(names, "name_id int, tokens array<string>, bound string").withColumn("bound", F.to_date("bound"))
    e = spark.createDataFrame(index, "entry_id int, tokens array<string>, released string").withColumn("released", F.to_date("released"))
    got = sorted((x.name_id, x.place, x.entry_id, x.overlap, round(x.jaccard, 9)) for x in M.match_titles(n, e, 3, most).collect())
    want = []
    for i, a, bound in names:
        scored = [(-len(set(a) & set(b)) / len(set(a) | set(b)), -len(set(a) & set(b)), tuple(-ord(c) for c in d or " "), k) for k, b, d in index if set(a) & set(b) and (bound is None or (d and d >= bound))]
        want += [(i, place, x[3], -x[1], round(-x[0], 9)) for place, x in enumerate(sorted(scored)[:3], 1)]
    assert got == sorted(want)


def test_a_token_of_all_titles_makes_no_pairs(spark):
    n = spark.range(2000).select(F.col("id").alias("name_id"), F.array(F.lit("all"), F.concat(F.lit("n"), F.col("id").cast("string"))).alias("tokens"), F.lit(None).cast("date").alias("bound"))
    e = n.select(F.col("name_id").alias("entry_id"), "tokens", F.col("bound").alias("released"))
    out = M.match_titles(n, e, 2)
    best = {(x.name_id, x.place): (x.entry_id, x.overlap) for x in out.collect()}
    assert all(best[k, 1] == (k, 2) and best[k, 2] == (0 if k else 1, 1) for k in range(2000))
    metrics = []

    def walk(node):
        if node.metrics().contains("numOutputRows"):
            metrics.append(node.metrics().apply("numOutputRows").value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    final = out._jdf.queryExecution().executedPlan()
    walk(final.executedPlan() if final.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else final)
    assert max(metrics, default=0) < 20_000  # all pairs are four million


def most_rows(df):
    """The largest number of rows that a node of the executed plan made."""
    metrics = []

    def walk(node):
        if node.metrics().contains("numOutputRows"):
            metrics.append(node.metrics().apply("numOutputRows").value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    final = df._jdf.queryExecution().executedPlan()
    walk(final.executedPlan() if final.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else final)
    return max(metrics, default=0)


@pytest.mark.parametrize("hottest", [0, 3, 12])
def test_titles_of_many_hot_tokens(spark, hottest):
    """Every set of nine tokens is a title: their classes make no pairs, with any number of them dealt with as sets."""
    sets = [(x, [f"t{k}" for k in range(9) if x >> k & 1]) for x in range(1, 512)]
    n = spark.createDataFrame([(x, t, None) for x, t in sets], "name_id int, tokens array<string>, bound date")
    e = spark.createDataFrame([(x, [*t, "more"], None) for x, t in sets], "entry_id int, tokens array<string>, released date")
    out = M.match_titles(n, e, 3, 20, hottest)
    got = sorted((x.name_id, x.place, x.entry_id, x.overlap) for x in out.collect())
    want = []
    for x, _ in sets:
        scored = sorted((-(x & y).bit_count() / ((x | y).bit_count() + 1), -(x & y).bit_count(), y) for y, _ in sets if x & y)
        want += [(x, place, y, -o) for place, (_, o, y) in enumerate(scored[:3], 1)]
    assert got == sorted(want)
    if hottest == 12:
        assert most_rows(out) < 100_000  # pairs of titles are 242,461


def counting(loads, calls, passes):
    def load():
        loads.add(1)

        def model(frame):
            calls.add(len(frame))
            return pd.DataFrame({"passes": frame["text"].map(passes), "reason": "model"})

        return model

    return load


def test_a_classifier_is_called_on_misses_only(spark):
    loads, calls = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([(k, f"t{k % 10}", "other") for k in range(40)] + [(50, None, "x")], "item_id long, text string, more string").repartition(4)
    memo = spark.createDataFrame([("t0", False), ("t0", True), ("t1", None), ("gone", True)], "text string, passes boolean").select(remembered_by("2", "text").alias("fingerprint"), "passes", F.lit("memo").alias("reason"))
    c = Classifier(counting(loads, calls, lambda t: None if t == "t9" or t is None else t > "t5"), ("text",), "2", memo)
    verdicts, new = classified(rows, c)
    got = {r.item_id: (r.passes, r.reason, r.remembered) for r in verdicts.collect()}
    verdicts.count()
    assert got == {k: (True, "memo", True) if k % 10 == 0 else (k % 10 > 5, "model", False) for k in range(40) if k % 10 != 9}
    assert calls.value == 10 and 1 <= loads.value <= 4 + 1  # t1 .. t9 and the null text, once each
    assert new.count() == 8 and calls.value == 10
    again, none = classified(rows.where("text <> 't9'"), Classifier(c.load, ("text",), "2", memo.union(new)))
    assert again.where("not remembered").count() == 0 and none.count() == 0 and calls.value == 10
    assert classified(rows.limit(0), c)[0].count() == 0


def test_the_funnel_takes_a_classifier_for_a_tier(spark):
    calls = [spark.sparkContext.accumulator(0) for _ in range(4)]
    body = F.concat(F.repeat(F.lit("abcdefghij"), 60), (F.col("id") % 6).cast("string"))
    rows = spark.range(30).select(F.col("id").alias("item_id"), F.lit("s").alias("source"), F.lit("2024-05-01").cast("date").alias("date"), F.col("id").alias("ingest_seq"), F.when(F.col("id") != 7, body).otherwise("short").alias("text"))
    tiers = [
        ("screen", Classifier(counting(*calls[:2], lambda t: t[-1] != "0"), ("text",))),
        ("triage", Classifier(counting(*calls[2:], lambda t: None if t[-1] == "5" else t[-1] != "3"), ("text",))),
    ]
    out = J.funnel(rows, [], "2024-01-01", "2024-12-31", [], tiers)
    tier = {r.item_id: r.tier for r in out.drops.collect()}
    want = {k: "text" if k == 7 else {0: "screen", 3: "triage", 5: "triage: retry"}.get(k % 6) for k in range(30)}
    assert tier == {k: v for k, v in want.items() if v} and out.kept.count() == sum(v is None for v in want.values())
    assert (calls[1].value, calls[3].value) == (6, 5)  # equal texts once; triage sees what passed the screen


def test_a_model_gets_long_texts_in_parts(spark):
    """Forty texts of 100,000 characters come in one batch; the model gets about a million characters at a time."""
    docs = spark.range(40).repartition(1).select(F.col("id").alias("item_id"), F.concat(F.repeat(F.lit("x"), 100_000), F.col("id").cast("string")).alias("text"))

    def load():
        return lambda frame: pd.DataFrame({"passes": True, "reason": [str(frame["text"].str.len().sum())] * len(frame)})

    got = classified(docs, Classifier(load, ("text",)))[0].collect()
    assert len(got) == 40 and max(int(r.reason) for r in got) < 1_200_000
