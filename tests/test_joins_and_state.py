import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from docwatch.operators import match as M
from docwatch.operators import select as S
from docwatch.operators import state as G
from docwatch.operators import stats as E

D = dt.date


def test_selection_semantics(spark):
    rows = [(1, "a", None, 1), (2, "a", D(2024, 1, 10), 2), (2, "b", D(2024, 1, 12), 1), (3, "a", D(2024, 1, 9), 3), (4, "a", D(2025, 1, 1), 4), (5, "x", D(2000, 1, 1), 5), (6, "a", D(2024, 1, 20), 6), (7, "a", D(2001, 1, 1), 7), (7, "b", D(2024, 1, 11), 8)]
    df = spark.createDataFrame(rows, "item_id long, source string, date date, ingest_seq int")
    chosen, lost = S.select_candidates(df, [spark.createDataFrame([(6,)], "id long")], "2024-01-10", "2024-02-01", ["x"])
    assert sorted((r.item_id, r.source) for r in chosen.collect()) == [(1, "a"), (2, "b"), (5, "x"), (7, "b")]
    assert [(r.source, r.floored) for r in lost.collect()] == [("a", 1)]
    assert spark.range(1).select(S.since_date("2024-01-10", "2024-02-01"), S.since_date(None, "2024-02-01"), S.since_date("2024-03-10", "2024-02-01")).first()[:] == (D(2024, 1, 8), D(2024, 1, 11), D(2024, 2, 1))


def test_rotating_slices_cover_everything(spark):
    df = spark.range(10).select((F.col("id") * 3).alias("k"))
    seen = [r.k for day in range(5) for r in S.rotating_slice(df, "k", 4, day).collect()]
    assert len(seen) == 20 and set(seen) == {3 * k for k in range(10)}
    assert sorted((r.k, r["rank"]) for r in S.distributed_rank(df, "k", 3).collect()) == [(3 * k, k) for k in range(10)]


def test_greedy_dedup_is_the_sequential_one(spark):
    r = random.Random(2)
    for n, m in ((30, 40), (12, 11), (25, 0)):
        groups = [r.sample(range(n), r.choice([2, 2, 3, 5])) for _ in range(m)] if m != 11 else [(k, k + 1) for k in range(11)]
        df = spark.createDataFrame([(k,) for k in range(n)], "item_id long")
        keys = spark.createDataFrame([(k, f"g{g}") for g, members in enumerate(groups) for k in members], "item_id long, key string")
        got = {x.item_id for x in M.dedup_greedy(df, keys).collect()}
        if m < 40:  # by rounds alone, and by rounds until few are left
            assert {x.item_id for x in M.dedup_greedy(df, keys, last=8 if m else 0).collect()} == got
        kept = []
        for k in range(n):
            if not any(k in members and j in members for members in groups for j in kept):
                kept.append(k)
        assert got == set(kept)


def test_same_item_keys(spark):
    schema = "item_id long, source string, date date, docket_tokens array<string>, party_tokens array<string>"
    rows = [(1, "a", D(2024, 1, 1), ["D100"], ["smith", "jones"]), (2, "a", None, ["D100"], ["smith", "jones"]), (3, "a", D(2024, 1, 1), [], ["roe", "smith", "jones"]), (4, "b", D(2024, 1, 1), ["D100"], ["smith", "jones"]), (5, "a", D(2024, 1, 1), [], ["smith", "doe"]), (6, "a", D(2024, 1, 1), None, None)]
    links = {(x.item_id, x.first_id) for x in M.same_item_links(spark.createDataFrame(rows, schema)).collect()}
    assert links == {(2, 1), (3, 1)}


def test_reverse_sweep_caps_and_order(spark):
    items = spark.createDataFrame([(1, "ok", D(2024, 1, 1), None), (2, "ok", D(2020, 1, 1), D(2024, 1, 1)), (3, "superseded", D(2024, 1, 1), None)], "item_id long, status string, date date, full_at date")
    e = [(k, 1, D(2024, 2, k)) for k in range(4, 15)] + [(1, 1, D(2024, 2, 1)), (30, 2, D(2020, 5, 1)), (31, 2, D(2024, 5, 1)), (32, 3, D(2024, 5, 1)), (33, 1, D(2023, 1, 1))]
    edges = spark.createDataFrame(e, "src_id long, dst_id long, ts date")
    out = M.reverse_sweep(items, edges, spark.createDataFrame([(1, 14)], "item_id long, citer_id long"), spark.createDataFrame([(1, 4)], "item_id long, citer_id long"), "2024-06-01", per_item=3, per_run=10).collect()
    assert [(r.item_id, r.citer_id) for r in out] == [(1, 4), (1, 13), (1, 12), (2, 31)]


def test_sweep_keeps_to_its_courts(spark):
    items = spark.createDataFrame([(1, "ok", D(2024, 1, 1), None)], "item_id long, status string, date date, full_at date")
    edges = spark.createDataFrame([(5, 1, D(2024, 2, 1), "a"), (6, 1, D(2024, 2, 2), "b"), (7, 1, D(2024, 2, 3), None), (8, 1, D(2024, 2, 4), "a")], "src_id long, dst_id long, ts date, court string")
    none = spark.createDataFrame([], "item_id long, citer_id long")
    pending = spark.createDataFrame([(1, 9, "b"), (1, 10, "a")], "item_id long, citer_id long, court string")
    run = lambda scope, **caps: [r.citer_id for r in M.reverse_sweep(items, edges, none, pending, "2024-06-01", scope=scope, **caps).collect()]
    assert run(["a"]) == [10, 8, 5] and run(["a"], per_item=2) == [10, 8] and run([]) == [] and run(None) == [10, 9, 8, 7, 6, 5]


def test_positions_of_a_hot_group(spark):
    rows = [("hot", k) for k in range(500)] + [(None, k) for k in range(3)] + [("cold", 7)]
    df = spark.createDataFrame(rows, "g string, k int").repartition(5)
    out = S.positions(df, ["g"], [F.desc("k")], ranges=12)
    assert {(r.g, r.k): r.position for r in out.collect()} == {(g, k): (500 - k if g == "hot" else 3 - k if g is None else 1) for g, k in rows}
    assert S.positions(df, [], ["g", F.desc("k")], ranges=6).agg(F.countDistinct("position"), F.max("position")).first() == (504, 504)
    assert S.positions(df.where("k < 0"), ["g"], ["k"]).count() == 0
    share = df.repartitionByRange(12, "g", F.desc("k")).groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
    assert share < 120  # no task holds the hot group


def test_forced_reads_close_a_deferred_row(spark):
    schema = "item_id long, stage string, seq long, smell string, smell_outcome string, audit_verdict string, audit_depth string, audit_by string, audited_at string, audit_note string"
    log = spark.createDataFrame([(1, "triage", 1, "suspect", "deferred", None, None, None, None, None), (2, "triage", 2, "suspect", "deferred", "x", "skim", "a", "t", None), (1, "text", 3, None, None, "w", "full", "b", "t", "n")], schema)
    stamps = spark.createDataFrame([(1, "declined", "why"), (9, "declined", None)], "item_id long, verdict string, note string")
    once = G.stamp_forced(log, stamps, "forced", "2024-01-01")
    assert sorted((r.seq, r.audit_verdict, r.audit_depth, r.audit_by, r.audit_note) for r in once.collect()) == [(1, "declined", "full", "forced", "why"), (2, "x", "skim", "a", None), (3, "declined", "full", "forced", "why")]
    assert sorted(once.collect()) == sorted(G.stamp_forced(once, stamps, "forced", "2024-01-01").collect())
    assert [r.item_id for r in S.select_for_audit(once, ["triage"], 9).collect()] == [2]


def test_reference_tables(spark):
    tables = spark.createDataFrame([("ok", "2024-01-09"), ("empty", "2024-01-09"), ("undated", "soon"), ("old", "2023-01-01")], "name string, generated_at string")
    entries = spark.createDataFrame([(n,) for n in ("ok", "undated", "old", "headless")], "name string")
    assert {r.name: r.code for r in G.reference_health(tables, entries, "2024-01-10", 90).collect()} == {"ok": 0, "empty": 5, "undated": 5, "old": 5, "headless": 5}
    assert G.reference_health(tables, entries, "2024-01-10", 0).count() == 0 and G.reference_health(tables.where("false"), entries.where("false"), "2024-01-10", 90).count() == 0


def test_citation_windows(spark):
    docs = spark.createDataFrame([(9, "x" * 3000 + " In Smith we said " + "y" * 3000), (8, "nothing here")], "item_id long, text string")
    pairs = spark.createDataFrame([(1, 9), (1, 8)], "item_id long, citer_id long")
    rows = {r.citer_id: r for r in M.citation_windows(pairs, docs, spark.createDataFrame([(1, "The Smith Inc v. Zeta")], "item_id long, name string")).collect()}
    assert rows[9].located and "Smith we said" in rows[9].window and len(rows[9].window) == 3000 and not rows[8].located and rows[8].window == "nothing here"


def test_quotes(spark):
    rec = spark.createDataFrame([(1, 'says "one thing" and "Smith v. Jones"', "Smith  v. Jones", None, "nothing"), (2, 'says "rate it high"', "n", None, None), (3, None, "n", None, None)], "key int, reason string, name string, docket string, evidence string")
    out = {r.key: r for r in M.verify_quotes(rec, spark.createDataFrame([("Rate it  high",)], "phrase string")).collect()}
    assert (out[1].unsupported, out[1].firm, out[1].echoed) == (["one thing"], True, []) and (out[2].echoed, out[2].firm) == (["rate it high"], False) and out[3].unsupported == []
    claims = spark.createDataFrame([(1, 1, "The  Rule"), (2, 1, "rul"), (3, 1, "a rule x"), (4, 9, "the rule")], "claim_id int, item_id int, quote string")
    got = {r.claim_id: r.grounded for r in M.grounded(claims, spark.createDataFrame([(1, "see the rule now")], "item_id int, text string")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}


def test_grounded_anywhere_against_all_pairs(spark):
    r = random.Random(6)
    words = ["ab", "cd", "ef", "gh", "i", "klm"]
    docs = [(k, " ".join(r.choices(words, k=40))) for k in range(60)]
    quotes = [(k, docs[k][1][r.randint(0, 9) : r.randint(12, 70)].upper().replace(" ", "  ")) for k in range(60)]
    got = {tuple(x) for x in M.grounded_anywhere(spark.createDataFrame(quotes, "quote_id int, quote string"), spark.createDataFrame(docs, "doc_id int, text string")).collect()}
    fold = lambda t: " ".join(t.lower().split())
    ok = lambda q: len(q) >= 6 or len(q) >= 4 and " " in q
    assert got == {(a, b) for a, q in quotes for b, t in docs if ok(fold(q)) and fold(q) in fold(t)}


def test_redate(spark):
    jan = D(2024, 1, 1)
    rows = [
        (10, "D1", jan, None, True), (11, "D2", None, D(2024, 2, 1), True), (12, "D3", jan, None, True), (13, "D4", jan, D(2030, 1, 1), True), (14, "D1", None, None, False),
        (15, "D5", jan, D(2024, 2, 2), False), (16, "D6", jan, None, False), (17, None, D(2024, 5, 5), None, True), (5, "D1", jan, None, True), (18, "D7", jan, D(2024, 2, 2), True),
    ]
    df = spark.createDataFrame(rows, "item_id long, docket string, date date, caption_date date, has_text boolean")
    index = spark.createDataFrame([("D1", D(2024, 3, 3))], "docket string, released date")
    known = spark.createDataFrame([(5, "D1", D(2024, 3, 3)), (10, "D1", D(2024, 3, 3)), (4, "D6", jan), (16, "D6", jan), (18, "D7", D(2024, 2, 2)), (3, None, D(2024, 5, 5))], "item_id long, docket string, date date")
    out = {r.item_id: (r.date, r.outcome, r.duplicate_of, r.unverified) for r in M.redate(df, index, known, "2024-06-01", "2024-05-05").collect()}
    assert out == {
        10: (jan, "duplicate", 5, False), 14: (None, "duplicate", 5, False), 5: (jan, "duplicate", 10, False), 11: (D(2024, 2, 1), "dated", None, False), 12: (jan, "unresolved", None, False), 13: (jan, "unresolved", None, False),
        15: (jan, "pending", None, False), 16: (jan, "duplicate", 4, False), 17: (D(2024, 5, 5), "unresolved", None, True), 18: (D(2024, 2, 2), "dated", None, False),
    }


def test_consensus_counts_the_budget(spark):
    rows = [("none", 1, "lost"), ("one", 1, "flag"), ("one", 2, "lost"), ("one", 3, "lost"), ("two", 1, "flag"), ("two", 2, "flag"), ("clear", 1, "clear"), ("clear", 2, "clear"), ("tie", 1, "flag"), ("tie", 2, "clear")]
    out = {r.item: (r.outcome, r.reason) for r in E.consensus(spark.createDataFrame([(a, b, c, f"{c}{b}") for a, b, c in rows], "item string, attempt int, vote string, reason string"), 3).collect()}
    assert out == {"none": ("unavailable", None), "one": ("unavailable", None), "two": ("flag", "flag2"), "clear": ("clear", None), "tie": ("unavailable", None)}


def test_gates_fail_closed(spark):
    golden = spark.createDataFrame([(1, "a", True)], "item_id long, source string, expect_relevant boolean")
    none = spark.createDataFrame([], "item_id long, tier1 boolean, tier2 boolean, significance string")
    assert not E.evaluate_gate(golden, none, [])[1].first().passed and not E.evaluate_gate(golden.limit(0), none, [])[1].first().passed
    ok = spark.createDataFrame([(1, False, True, None)], none.schema)
    assert E.evaluate_gate(golden, ok, ["a"])[1].first().passed and not E.evaluate_gate(golden, ok, [])[1].first().passed


def test_silent_failures(spark):
    bad, ok = "failure", "success"
    s = {
        "killed": [("x", bad), ("y", None), ("Complete job", ok)], "told": [("x", bad), ("File a report", ok)], "broken": [("x", bad), ("Open an ISSUE", bad)], "cut": [("x", bad), ("Report", "cancelled")],
        "no failed step": [("x", ok), ("y", "cancelled")], "cleaned": [("Harden", ok), ("x", bad), ("Report", "skipped"), ("Post Harden", ok)], "posted": [("x", bad), ("Post the diagnosis", ok)],
        "worked on": [("x", bad), ("y", bad)],
    }
    steps = spark.createDataFrame([(j, k, *x) for j, rows in s.items() for k, x in enumerate(rows)], "job string, pos int, name string, conclusion string")
    jobs = spark.createDataFrame([(j, bad) for j in (*s, "empty")] + [("fine", ok)], "job string, conclusion string")
    out = {r.job for r in E.silent_failures(steps, jobs).where("silent").collect()}
    assert out == {"killed", "broken", "cut", "no failed step", "cleaned", "empty"}


def test_feed_codes(spark):
    rows = lambda *s: spark.createDataFrame([(x,) for x in s], "source string")
    code = lambda raw, parsed, feeds=None: E.feed_shape(raw, parsed, feeds)[1].first().code
    assert code(rows("a", "a", "b"), rows("a")) == 0  # one source that yields is proof that the parser works
    assert code(rows("a", "b"), rows()) == 3 and code(rows(), rows()) == 4 and code(rows(), rows(), rows("a", "b")) == 4
    shape = {r.source: (r.entries, r.parsed, r.status) for r in E.feed_shape(rows("a", "a", "b"), rows("a"), rows("a", "b", "c"))[0].collect()}
    assert shape == {"a": (2, 1, "ok"), "b": (1, 0, "no-candidates"), "c": (0, 0, "empty")}


def test_upgrades(spark):
    models = spark.createDataFrame([("s", "m-5", "2026-02-01", 5), ("s", "m-4-20250101", "2025-01-01", 4), ("h", "h-4-20251001", "2025-10-01", 4), ("o", "o-3", None, 3), ("o", "o-2", "2024-01-01", 2)], "tier string, name string, created string, version int")
    def upgrades(**pins):  # noqa: E306
        rows = E.newest_per_group(models, spark.createDataFrame(list(pins.items()), "tier string, name string")).collect()
        return {r.tier: (r.newest, r.upgrade, r.pin_missing) for r in rows if r.pin}
    assert upgrades(s="m-4", h="h-4", o="o-2") == {"s": ("m-5", True, False), "h": ("h-4-20251001", False, False), "o": ("o-3", True, False)}
    assert upgrades(s="m-3", h="h-4-20251001") == {"s": ("m-5", True, True), "h": ("h-4-20251001", False, False)}
    assert upgrades(s="m-5-20260202") == {"s": ("m-5", False, False)}


def test_invert_references_needs_rows(spark):
    none = spark.createDataFrame([], "authority string, dependant string")
    with pytest.raises(ValueError):
        E.invert_references(none, none, none)


def test_rolling_usage_against_brute_force(spark):
    r = random.Random(1)
    rows, t = [], 0
    for k in range(300):
        t += r.choice([0, 1, 5, 30, 200])
        rows.append((k, k % 2, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t)))
    df = spark.createDataFrame(rows, "event_id int, who int, ts timestamp")
    for x in G.rolling_usage(df, "who", "ts", {"m": (60, 3), "h": (600, 10)}).collect():
        before = [b for b in rows if b[1] == x.who and (b[2], b[0]) < (x.ts, x.event_id)]
        used = [sum((x.ts - b[2]).total_seconds() < w for b in before) for w in (60, 600)]
        assert [x.used_m, x.used_h] == used
        assert (x.wait_seconds > 0) == (used[0] >= 3 or used[1] >= 10)


def test_merge_keeps_first_seen_and_is_idempotent(spark):
    schema = "id int, v string, first_seen date"
    old = spark.createDataFrame([(1, "a", D(2020, 1, 1)), (2, "b", D(2020, 1, 1))], schema)
    new = spark.createDataFrame([(1, "x", D(2024, 1, 1)), (1, "y", D(2024, 1, 1)), (3, "c", D(2024, 1, 1))], schema)
    out = G.merge_items(old, new, "id", "v")
    want = [(1, "y", D(2020, 1, 1)), (2, "b", D(2020, 1, 1)), (3, "c", D(2024, 1, 1))]
    assert sorted((r.id, r.v, r.first_seen) for r in out.collect()) == want and tuple(G.merge_counts(out).first()) == (1, 1)
    again = G.merge_items(out.drop("action"), new, "id", "v", ["v"])
    assert sorted((r.id, r.v, r.first_seen) for r in again.collect()) == want and tuple(G.merge_counts(again).first()) == (0, 0)


def test_flags_only_rise(spark):
    items = spark.createDataFrame([(1, "ok", None), (2, "superseded", None), (3, "caution", D(2020, 1, 1)), (4, "ok", None)], "item_id long, status string, treatment_date date")
    f = spark.createDataFrame([(k, 9, "overruled", True, D(2024, 1, 1)) for k in (1, 2, 3)] + [(4, 9, "cited", True, D(2024, 1, 1)), (4, 8, "overruled", False, D(2024, 1, 1))], "item_id long, citer_id long, kind string, affects boolean, date date")
    out, new = G.raise_flags(items, spark.createDataFrame([], "item_id long, citer_id long"), f, ["overruled"])
    assert [(r.status, r.treatment_date) for r in out.orderBy("item_id").collect()] == [("caution", D(2024, 1, 1)), ("superseded", None), ("caution", D(2020, 1, 1)), ("ok", None)]
    assert new.count() == 3 and G.raise_flags(out.drop("raised"), new, f, ["overruled"])[1].count() == 0


def ids(spark, *x):
    return spark.createDataFrame([(k,) for k in x], "item_id long")


def test_marks(spark):
    none = spark.createDataFrame([], "item_id long, n int")

    def go(mark, found, resolved=(), waiting=(), tries=(), failed=(), covered=None, most=3):
        held = spark.createDataFrame(list(tries), none.schema)
        after, gave, left = G.advance_mark(mark, *(ids(spark, *x) for x in (found, resolved, waiting)), held, ids(spark, *failed), covered, most)
        return after.first().mark, sorted(r.item_id for r in gave.collect()), {r.item_id: r.n for r in left.collect()}

    assert go(10, [11, 12, 15], [11, 15]) == (11, [], {})
    assert go(10, [11, 12], [11], tries=[(12, 2)], failed=[12]) == (12, [12], {})
    assert go(10, []) == (10, [], {}) and go(10, [5, 14], [14]) == (14, [], {})
    assert go(10, [21], [21], tries=[(15, 1)]) == (21, [], {})  # an id that was not found holds nothing; its tries end with the mark
    assert go(10, [12, 21], [21], tries=[(12, 3)]) == (21, [12], {})  # at its limit, though it did not fail now
    assert go(10, [12, 20], [12, 20], covered=40) == (40, [], {}) and go(10, [12, 20], [12], covered=15) == (15, [], {})
    assert go(10, [12, 14, 20], [20], waiting=[12], tries=[(12, 9), (30, 1)], failed=[12, 14]) == (11, [], {14: 1, 30: 1})
    assert go(10, [12, 14], waiting=[14], failed=[12], most=1) == (13, [12], {})


def test_retry_pending(spark):
    key = "item_id long, citer_id long"
    old = D(2024, 1, 1)
    p = spark.createDataFrame([(1, 1, 3, None), (1, 2, 0, old), (1, 3, 0, None), (1, 4, 2, old), (1, 6, 1, old), (1, 7, 1, D(2024, 2, 20))], f"{key}, tries int, text_since date")
    pair = lambda *c: spark.createDataFrame([(1, k) for k in c], key)
    out = lambda stopped: {r.citer_id: (r.tries, r.text_since, r.action) for r in G.retry_pending(p, pair(1, 3, 5, 6), pair(3), pair(2, 7, 8), stopped, "2024-03-01").collect()}
    today = D(2024, 3, 1)
    same = {2: (0, old, "manual"), 3: (0, None, "done"), 4: (2, old, "retry"), 7: (1, D(2024, 2, 20), "retry"), 8: (0, today, "retry")}  # 4 was not reached: its clock goes on
    assert out(False) == same | {1: (4, None, "manual"), 5: (1, None, "retry"), 6: (2, None, "retry")}
    assert out(True) == same | {1: (3, None, "retry"), 5: (0, None, "retry"), 6: (1, None, "retry")}


def test_two_strikes(spark):
    urls = lambda *u: spark.createDataFrame([(x,) for x in u], "url string")
    state = spark.createDataFrame([], "url string, first_failed long, last_failed long, confirmed_at long")
    state = G.two_strike(state, urls("a", "b"), 0).drop("due")
    early = G.two_strike(state, urls("a"), 3600)
    assert [(r.url, r.confirmed_at) for r in early.collect()] == [("a", None)]
    late = G.two_strike(early.drop("due"), urls("a"), 86_400).first()
    assert (late.first_failed, late.confirmed_at) == (0, 86_400)


def test_review(spark):
    staged = spark.createDataFrame([(3, None), (4, None), (5, 3), (6, 90), (7, 99), (8, None), (9, None)], "item_id long, card_id long")
    decisions = spark.createDataFrame([(2, "veto"), (4, "decline"), (4, "veto"), (1, "note")], "item_id long, decision string")
    run = lambda pending, published, **more: {r.item_id: r.outcome for r in G.reconcile_review(pending, staged, decisions, published, **more).collect()}
    pending, published = ids(spark, 1, 2, 3, 4, 5, 6, 8), ids(spark, 8, 90)
    # 1: its file was dropped; 4: blocked though its file is back; 5: changes a card of this batch; 7: its card is unknown; 8: published before
    want = {1: "vetoed", 2: "vetoed", 3: "accepted", 4: "declined", 5: "accepted", 6: "accepted", 7: "skipped", 8: "vetoed", 9: "accepted"}
    assert run(pending, published) == want == run(pending.union(pending), published)
    again = run(ids(spark), published.union(ids(spark, 3, 9)))
    assert again == {3: "skipped", 4: "skipped", 5: "accepted", 6: "accepted", 7: "skipped", 8: "skipped", 9: "skipped"}  # a change is applied to the same end
    assert run(pending, published, merged=False) == dict.fromkeys((1, 2, 3, 4, 5, 6, 8), "vetoed")


def test_seen_cap_keeps_the_largest(spark):
    assert sorted(r.item_id for r in G.advance_seen(3, ids(spark, 9), ids(spark, 1, 9, 5), ids(spark, 7, 3)).collect()) == [3, 5, 7]


def test_health(spark):
    status = lambda s: spark.createDataFrame([(s,)], "scanned_at string")
    content = lambda *c: spark.createDataFrame([(x,) for x in c], "content_at string")
    code = lambda s, c: G.health_report(status(s), c, "2024-01-10 00:00:00").first()
    assert code("2024-01-09T12:00:00Z", content("2024-01-05")).code == 0 and code("2024-01-09T12:00:00Z", content("2024-01-05")).trust_silence
    assert code("2024-01-01", content("2024-01-05")).code == 3 and code("soon", content("2024-01-05")).code == 4
    assert code("2024-01-09T12:00:00Z", content("soon")).code == 4 and code("2024-01-09T12:00:00Z", content()).code == 0


def test_memo_asks_only_for_misses(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "item_id int, text string").withColumn("fingerprint", G.input_fingerprint("text"))
    hit, miss = G.memo_verdicts(rows, rows.where("item_id = 1").select("fingerprint", F.lit("v").alias("verdict")))
    assert hit.first().verdict == "v" and [r.item_id for r in miss.collect()] == [2]


def test_page_state_moves_only_after_extraction(spark):
    pages = spark.createDataFrame([("a", "1", False, True), ("b", "2", False, False), ("c", "3", True, True), ("d", None, None, False), ("e", "5", False, True)], "url string, hash string, is_shell boolean, extracted boolean")
    outcome, state = G.detect_page_changes(pages, spark.createDataFrame([("a", "0"), ("b", "0"), ("c", "0"), ("d", "0"), ("e", "5"), ("z", "9")], "url string, hash string"))
    assert {r.url: r.outcome for r in outcome.collect()} == {"a": "changed", "b": "changed", "c": "shell", "d": "unreachable", "e": "unchanged"}
    assert {r.url: r.hash for r in state.collect()} == {"a": "1", "b": "0", "c": "0", "d": "0", "e": "5", "z": "9"}


def test_audit_depth_never_weakens(spark):
    log = spark.createDataFrame([(1, "v", "full"), (2, None, None)], "key int, verdict string, depth string")
    out, outcome = G.record_audits(log, spark.createDataFrame([(1, "w", "skim"), (2, "w", "skim"), (3, "w", "full")], log.schema))
    assert {r.key: (r.verdict, r.depth) for r in out.collect()} == {1: ("v", "full"), 2: ("w", "skim")} and {r.key: r.outcome for r in outcome.collect()} == {1: "skipped", 2: "applied", 3: "missing"}


def test_abandoned_list(spark):
    """A listed item that is given up again keeps its reason and day; a retried one takes its new reason; new ones come in."""
    listed = spark.createDataFrame([(1, "old", 1, D(2024, 1, 1)), (2, "old", 0, D(2024, 1, 1)), (3, "old", 0, D(2024, 1, 1)), (4, "old", 2, D(2024, 1, 1))], "item_id long, reason string, retries int, last_try date")
    gave = spark.createDataFrame([(1, "again"), (9, "lost")], "item_id long, reason string")
    retried = spark.createDataFrame([(2, "new"), (3, None)], "item_id long, reason string")
    out = {r.item_id: tuple(r)[1:] for r in G.update_abandoned(listed, gave, retried, ids(spark, 4), "2024-03-01").collect()}
    day = D(2024, 3, 1)
    assert out == {1: ("old", 1, D(2024, 1, 1)), 2: ("new", 1, day), 3: ("old", 1, day), 9: ("lost", 0, day)}


def test_suspects_that_are_not_failing_leave(spark):
    """Healthy and unchecked urls alike."""
    state = spark.createDataFrame([("a", 0, 0, None), ("b", 0, 0, None)], "url string, first_failed long, last_failed long, confirmed_at long")
    out = G.two_strike(state, spark.createDataFrame([("a",), ("c",)], "url string"), 90_000).collect()
    assert sorted((r.url, r.first_failed, r.confirmed_at) for r in out) == [("a", 0, 90_000), ("c", 90_000, None)]


def test_sweep_visits_few_new_items_and_marks_empty_ones_full(spark):
    from docwatch.plans import jobs as J

    day = D(2024, 1, 1)
    rows = spark.createDataFrame([(i, "A v. B", "ok", day, day if i > 5 else None) for i in range(1, 8)], "item_id long, name string, status string, date date, full_at date")
    edges = spark.createDataFrame([(100 + i, i, D(2024, 5, 1)) for i in (1, 4, 6)], "src_id long, dst_id long, ts date")
    assert sorted(r.item_id for r in M.visited(rows, 3).collect()) == [1, 2, 3, 6, 7]
    none = spark.createDataFrame([], "item_id long, citer_id long")
    pending = spark.createDataFrame([], "item_id long, citer_id long, tries int, text_since date")
    verdicts = spark.createDataFrame([], "item_id long, citer_id long, kind string, affects boolean")
    docs = spark.createDataFrame([(101, "Bob"), (106, "Bob")], "item_id long, text string")
    out = J.treatment_sweep(rows.withColumn("treatment_date", F.col("date")).withColumn("first_seen", F.col("date")), edges, docs, none, pending, verdicts, "2024-06-01", False, ["overruled"])
    assert sorted(r.citer_id for r in out["run"].collect()) == [101, 106]
    assert {r.item_id for r in out["sweep"].where("full").collect()} == {1, 2, 3, 6, 7}
