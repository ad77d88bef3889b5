import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docwatch.plans import jobs
from docwatch.streaming import streams as S
from docwatch.streaming.parts import PartedTable

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def folder(spark, tmp_path):
    def write(name, rows, schema, parts=3):
        spark.createDataFrame(rows, schema).repartition(parts).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


def test_dedup_keeps_one_row_per_key(spark, folder):
    d = folder("x", [(k % 5, T0 + dt.timedelta(hours=k)) for k in range(40)], "item_id long, ts timestamp")
    out = S.drain(S.stream_dedup(S.file_stream(spark, d, "x"), "item_id", "ts", "10 days", spark.createDataFrame([(3,)], "item_id long")))
    assert sorted(r.item_id for r in out.collect()) == [0, 1, 2, 4]


def test_two_strikes_by_event_time(spark, folder):
    day = dt.timedelta(days=1)
    rows = [("a", True, T0), ("a", True, T0 + day / 2), ("a", True, T0 + 2 * day), ("b", True, T0), ("b", False, T0 + day), ("b", True, T0 + 2 * day), ("c", False, T0)]
    d = folder("x", rows, "url string, failed boolean, ts timestamp", 1)
    out = S.drain(S.stream_two_strike(S.file_stream(spark, d, "x"))).collect()
    first = int(T0.replace(tzinfo=dt.UTC).timestamp())
    assert [(r.url, r.first_failed, r.confirmed_at) for r in out] == [("a", first, first + 2 * 86_400)]


def test_staleness_sees_gaps(spark, folder):
    rows = [("a", T0 + dt.timedelta(hours=h)) for h in (0, 1, 50)] + [("b", T0 + dt.timedelta(hours=h)) for h in range(0, 60, 10)]
    d = folder("x", rows, "source string, ts timestamp", 1)
    out = S.drain(S.stream_staleness(S.file_stream(spark, d, "x"), 36)).collect()
    assert [(r.source, r.open) for r in out] == [("a", False)]


def test_strikes_and_gaps_of_busy_keys_against_brute_force(spark, folder):
    rng, us = random.Random(3), lambda t: round((t - T0).total_seconds() * 10**6)
    base = int(T0.replace(tzinfo=dt.UTC).timestamp())
    rows = [(u, rng.random() < 0.8, T0 + dt.timedelta(milliseconds=100 * rng.randrange(300))) for u in ("hot", "b", None) for _ in range(400 if u == "hot" else 30)]
    rows += [("c", True, None), ("c", None, T0)]
    strikes = []
    for u in {r[0] for r in rows}:
        first = None
        for t, failed in sorted((us(t), bool(f)) for v, f, t in rows if v == u and t):
            now = base + t // 10**6
            if not failed:
                first = None
            elif first is None:
                first = now
            elif now - first >= 2:
                strikes.append((u, first, now))
                first = None
    d = folder("x", rows, "url string, failed boolean, ts timestamp", 4)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)  # a key comes in many frames
    try:
        got = S.drain(S.stream_two_strike(S.file_stream(spark, d, "x"), 2)).collect()
        assert len(strikes) > 3 and sorted(map(tuple, got), key=str) == sorted(strikes, key=str)

        seen = [(s, T0 + dt.timedelta(minutes=rng.randrange(60 * 24 * days))) for s, n, days in (("hot", 500, 9), ("rare", 12, 9), (None, 9, 9)) for _ in range(n)]
        gaps = [(s, a, False) for s in {r[0] for r in seen} for t in [sorted(base + us(x) // 10**6 for v, x in seen if v == s)] for a, b in zip(t, t[1:]) if b - a > 5 * 3600]
        d = folder("y", seen, "source string, ts timestamp", 4)
        got = S.drain(S.stream_staleness(S.file_stream(spark, d, "y"), 5, "20 days")).collect()
        assert len(gaps) > 5 and sorted((tuple(r) for r in got if not r.open), key=str) == sorted(gaps, key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_strikes_go_on_after_a_restart(spark, folder):
    home = S.work_folder(spark)
    schema = "url string, failed boolean, ts timestamp"
    day = dt.timedelta(days=1)
    d = folder("x", [("a", True, T0), ("b", True, T0)], schema, 1)
    assert S.drain(S.stream_two_strike(S.file_stream(spark, d, "x")), folder=home).count() == 0
    spark.createDataFrame([("a", True, T0 + 2 * day), ("b", False, T0 + day), ("b", True, T0 + 2 * day)], schema).coalesce(1).write.mode("append").parquet(f"{d}/x.parquet")
    assert [r.url for r in S.drain(S.stream_two_strike(S.file_stream(spark, d, "x")), folder=home).collect()] == ["a"]


def test_usage_against_brute_force_over_restarts(spark, folder, monkeypatch):
    monkeypatch.setattr(S, "MERGE", 30)  # parts are merged many times
    rng, home, minute, schema = random.Random(5), S.work_folder(spark), 60_000_000, "who long, ts timestamp"
    d, taken, over = folder("usage", [], schema), [], 0
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)  # a part comes in many frames
    try:
        for k, end in enumerate((100, 101.5, 104.5, 190, 191, 400)):
            rows = [(w, T0 + dt.timedelta(seconds=rng.randrange(round(60 * end)))) for w, n in ((1, 150), (2**60 + 1, 40), (2**60, 6), (None, 20), (7, 3)) for _ in range(n)]
            rows += [(k, T0 + dt.timedelta(minutes=end)), (1, None)]
            spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(f"{d}/usage.parquet")
            calls = [(w, (t.replace(tzinfo=dt.UTC) - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(microseconds=1)) for w, t in rows if t]
            taken += [(w, t) for w, t in calls if (t // minute + 1) * minute > over]  # the others are late
            over = max(over, max(t for _, t in calls) - 10 * minute)
            windows = Counter((w, s * minute) for w, t in taken for s in range(t // minute - 4, t // minute + 1) if (s + 5) * minute <= over)
            runs = S.drain(S.stream_usage(S.file_stream(spark, d, "usage"), "who", "ts", "5 minutes", "1 minute", "10 minutes", parts=2), folder=home)
            got = S.usage_windows(runs, "who", "5 minutes").select("who", F.unix_micros("start"), F.unix_micros("end"), "calls").collect()
            assert sorted(map(tuple, got), key=str) == sorted(((w, s, s + 5 * minute, n) for (w, s), n in windows.items()), key=str)
        assert len(windows) > 300 and len(taken) < 6 * 200  # some calls were late
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_usage_keeps_no_windows(spark, folder):
    rows = [(k % 40, T0 + dt.timedelta(minutes=37 * k)) for k in range(400)]
    d = folder("x", rows, "who long, ts timestamp")
    stream = S.stream_usage(S.file_stream(spark, d, "x"), "who", "ts")
    q = stream.writeStream.format("noop").option("checkpointLocation", S.work_folder(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(o["numRowsUpdated"] for p in q.recentProgress for o in p["stateOperators"]) <= 2 * len(rows)
    assert S.drain(stream).count() <= 2 * len(rows)


def test_late_verdicts_join_their_version(spark, folder):
    folder("q", [(1, "h", T0), (2, "h", T0), (3, "h", T0), (9, "h", T0 + dt.timedelta(days=90))], "item_id long, content_hash string, ts timestamp")
    d = folder("r", [(1, "h", T0 + dt.timedelta(days=3), "keep"), (2, "old", T0 + dt.timedelta(days=3), "keep"), (3, "h", T0 + dt.timedelta(days=30), "keep"), (9, "x", T0 + dt.timedelta(days=90), "drop")], "item_id long, content_hash string, ts timestamp, verdict string")
    out = {r.item_id: r.verdict for r in S.drain(S.stream_late_verdicts(S.file_stream(spark, d, "q"), S.file_stream(spark, d, "r"))).collect()}
    assert out.get(1) == "keep" and out.get(2) is None and out.get(3) is None and 9 not in out


def test_page_watch_and_batches(spark, folder):
    d = folder("p", [("u", "1", False, True), ("v", "2", True, True)], "url string, hash string, is_shell boolean, extracted boolean")
    assert {r.url: r.outcome for r in S.stream_page_watch(S.file_stream(spark, d, "p")).collect()} == {"u": "changed", "v": "shell"}
    d = folder("n", [(k,) for k in range(9)], "item_id long")
    assert S.stream_batches(S.file_stream(spark, d, "n"), lambda b, s: b.where("item_id % 2 = 0")).count() == 5


def test_streams_go_on_after_a_restart(spark, folder):
    keep = lambda b, s: b if s is None else b.join(s, "item_id", "left_anti")
    home = S.work_folder(spark)
    d = folder("g", [(k,) for k in range(5)], "item_id long")
    assert S.stream_batches(S.file_stream(spark, d, "g"), keep, home).count() == 5
    spark.createDataFrame([(k,) for k in range(3, 9)], "item_id long").write.mode("append").parquet(f"{d}/g.parquet")
    out = S.stream_batches(S.file_stream(spark, d, "g"), keep, home)
    assert sorted(r.item_id for r in out.collect()) == list(range(9))  # 3 and 4 are known from the first call
    home = S.work_folder(spark)
    schema = "url string, hash string, is_shell boolean, extracted boolean"
    d = folder("w", [("u", "1", False, True)], schema)
    S.stream_page_watch(S.file_stream(spark, d, "w"), home)
    spark.createDataFrame([("u", "1", False, True), ("v", "2", False, True)], schema).coalesce(1).write.mode("append").parquet(f"{d}/w.parquet")
    out = S.stream_page_watch(S.file_stream(spark, d, "w"), home).where("outcome = 'changed'")
    assert sorted(r.url for r in out.collect()) == ["u", "v"]  # u doesn't change again


def test_a_batch_reads_and_writes_its_own_parts_only(spark, tmp_path):
    t = PartedTable(spark, str(tmp_path / "t"), "k", "k long, v long", 8)
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v long")
    held, sizes = {}, []
    for b in range(12):
        batch = rows((b % 4, b), (None, b))
        touched = t.touched(batch)
        sizes.append(len(t.paths(b, touched)))
        before = {r.k: r.v for r in t.read(b, touched).collect()}
        assert before == {k: v for k, v in held.items() if t.touched(rows((k, 0)))[0] in touched}
        for _ in range(2 if b == 7 else 1):  # batch 7 comes twice
            kept = t.read(b, touched).where(f"k is not null and k <> {b % 4}")
            t.write(b, touched, kept.union(batch))
        held |= {b % 4: b, None: b}
    every = list(range(8))
    assert {r.k: r.v for r in t.read(12, every).collect()} == held
    assert max(sizes) <= 2  # files read don't grow with the batches before
    left = [p for p in (tmp_path / "t" / "rows").glob("*/part=*")]
    assert len(left) <= 2 * len(t.paths(12, every)) and len(list((tmp_path / "t" / "lists").glob("[0-9]*"))) == 2


def test_funnel_logs_every_drop(spark):
    text = "letters " * 100
    rows = spark.createDataFrame([(k, "s", dt.date(2024, 1, 5), k, text if k != 3 else "short", ["smith", "jones"] if k == 4 else ["x"]) for k in range(8)], "item_id long, source string, date date, ingest_seq int, text string, party_tokens array<string>")
    tier = spark.createDataFrame([(k, k not in (4, 5)) for k in range(8) if k != 6], "item_id long, passes boolean")
    curated = spark.createDataFrame([(99, ["smith", "jones", "roe"])], "item_id long, party_tokens array<string>")
    f = jobs.funnel(rows, [spark.createDataFrame([(0,)], "id long")], "2024-01-01", "2024-02-01", [], [("screen", tier)], curated)
    assert sorted(r.item_id for r in f.kept.collect()) == [1, 2, 4, 7]
    assert {r.item_id: r.tier for r in f.drops.collect()} == {3: "text", 5: "screen", 6: "screen: retry"}
    assert jobs.funnel_counts(f).agg(F.sum("n")).first()[0] == 7


def test_suspect_drops_and_their_outcomes(spark):
    day, text = dt.date(2024, 1, 5), "letters " * 100
    rows = [(k, "s", day, k, text, [f"D{k // 2}"], []) for k in range(2, 22)]  # two ids are a case
    df = spark.createDataFrame(rows, "item_id long, source string, date date, ingest_seq long, text string, docket_tokens array<string>, party_tokens array<string>")
    none = spark.createDataFrame([], "item_id long")
    screen = df.select("item_id", (F.col("item_id") != 20).alias("passes"), F.lit("").alias("reason"))  # a suspect reason, but not of the last tier
    lost = [2, 4, 5, 6, 8, 10, 12, 14, 16, 21]
    triage = df.select("item_id", (~F.col("item_id").isin(lost)).alias("passes"), F.lit("off").alias("reason"))
    verdict = {2: "suspect", 4: "suspect", 5: "suspect", 6: "ok", 21: "suspect", 3: "suspect"}
    smells = spark.createDataFrame(list(verdict.items()), "item_id long, verdict string")
    guards = {"g": spark.createDataFrame([], "item long, attempt int, vote string, reason string")}

    def run(reads, cap=9):
        f = jobs.funnel_run(df, [none], df.where("false"), "2024-01-01", "2024-02-01", [], [("screen", screen), ("triage", triage)], smells=smells, validity={"never": F.lit(False)}, guards=guards,
            overruling=none, cleared=none, seen=none, reads=reads, smell_cap=cap)
        return {r.item_id: (r.smell, r.smell_outcome) for r in f.smells.collect()}, {r.item_id for r in f.cards.collect()}, {r.item_id: r.tier for r in f.drops.collect()}

    reads = spark.createDataFrame([(4, False), (21, True)], "item_id long, passes boolean")
    smelled, cards, drops = run(reads)
    assert smelled == {2: ("suspect", "twin"), 4: ("suspect", "drop-stands"), 5: ("suspect", "twin"), 6: ("ok", None), 21: ("suspect", "carded")}
    assert 21 in cards and 21 not in drops and drops[2] == drops[4] == drops[5] == "triage" and drops[20] == "screen" and 3 in cards
    smelled, cards, _ = run(reads.where("item_id = 21"), 2)
    assert smelled[4] == ("suspect", "deferred") and smelled[21] == ("suspect", "capped") == smelled[5] and 21 not in cards
    assert run(None)[0][4] == ("suspect", "carded")
