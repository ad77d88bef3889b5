"""Queries of the composite jobs and of the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from docwatch.operators import state as G
from docwatch.plans import jobs as J
from docwatch.plans.roles import cand, edges, items, log, query, table, text
from docwatch.streaming import streams as S

TIERS = """t AS (SELECT item_id, source, date, text, (date <= DATE '2024-12-31' AND (date >= DATE '2024-03-01' OR source = 'src3')) AS p FROM cand WHERE item_id % 5 <> 0),
    g AS (SELECT item_id, source, CASE WHEN length(text) < 500 OR length(regexp_replace(text, '[^\\p{L}]', '', 'g')) < 100 THEN 'text'
        WHEN item_id % 6 = 0 THEN CASE WHEN item_id % 12 = 0 THEN 'screen: retry' ELSE 'screen' END WHEN item_id % 7 = 0 THEN 'triage' ELSE 'carded' END AS stage FROM t WHERE p)"""


def tiers(rows):
    i = F.col("item_id")
    return [("screen", rows.where("item_id % 12 <> 0").select("item_id", (i % 6 != 0).alias("passes"))), ("triage", rows.select("item_id", (i % 7 != 0).alias("passes")))]


RUN = """, b AS (SELECT item_id, source, text, item_id // 3 AS docket, item_id // 6 AS party, item_id % 5 = 0 AS known,
        date <= DATE '2024-12-31' AND (date >= DATE '2024-03-01' OR source = 'src3') AS p FROM cand),
    g AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM b k WHERE k.known AND k.source = c.source AND k.docket = c.docket) THEN 'duplicate'
        WHEN length(text) < 500 OR length(regexp_replace(text, '[^\\p{L}]', '', 'g')) < 100 THEN 'text'
        WHEN item_id % 12 = 0 THEN 'screen: retry'
        WHEN item_id % 6 = 0 AND NOT EXISTS (SELECT 1 FROM b k WHERE k.known AND k.source = c.source AND k.party = c.party) THEN 'screen'
        WHEN item_id % 7 = 0 THEN 'triage' END AS tier FROM b c WHERE p AND NOT known),
    m AS (SELECT *, CASE WHEN tier = 'triage' THEN CASE WHEN item_id % 21 = 0 OR item_id % 4 = 1 THEN 'suspect' WHEN item_id % 4 = 2 THEN 'ok' END END AS smell FROM g),
    c AS (SELECT *, smell = 'suspect' AND row_number() OVER (PARTITION BY smell ORDER BY item_id) <= 5 AS up FROM m),
    t AS (SELECT *, up AND (EXISTS (SELECT 1 FROM c o WHERE o.tier IS NULL AND o.source = c.source AND o.docket = c.docket)
            OR EXISTS (SELECT 1 FROM c o WHERE o.up AND o.source = c.source AND o.docket = c.docket AND o.item_id < c.item_id)) AS twin,
        row_number() OVER (PARTITION BY source, docket, tier IS NULL ORDER BY item_id) AS place FROM c),
    k AS (SELECT *, CASE WHEN smell IS DISTINCT FROM 'suspect' THEN NULL WHEN NOT up THEN 'capped' WHEN twin THEN 'twin' WHEN item_id % 9 = 0 THEN 'deferred' WHEN item_id % 5 = 1 THEN 'drop-stands' ELSE 'carded' END AS outcome FROM t),
    f AS (SELECT *, CASE WHEN tier IS NULL AND place = 1 OR outcome = 'carded' THEN NULL WHEN tier IS NULL THEN 'duplicate' ELSE tier END AS fate,
        len(list_filter([1, 2, 3], lambda x: (item_id * x) % 5 IN (1, 2))) AS flags, len(list_filter([1, 2, 3], lambda x: (item_id * x) % 5 IN (3, 4))) AS clears,
        len(list_filter([1, 2, 3], lambda x: (item_id + x) % 4 = 1)) AS gaps, len(list_filter([1, 2, 3], lambda x: (item_id + x) % 4 > 1)) AS shown FROM k),
    r AS (SELECT *, CASE WHEN (length(text) < 700 OR item_id % 9 = 0 OR flags > 1 OR clears < 2 OR gaps > 1 OR shown < 2 OR item_id % 10 = 1) AND item_id % 4 <> 3 THEN 'held' ELSE 'auto' END AS lane FROM f),
    l AS (SELECT source, count(*) AS floored FROM b WHERE NOT p AND NOT known GROUP BY 1)"""


def run(spark, d):
    """The whole funnel over documents: three consecutive ids of a source are one case, every fifth document is curated."""
    i = F.col("item_id")
    token = lambda name, c: F.concat(F.lit(name), c.cast("string"))
    rows = cand(spark, d).withColumn("docket_tokens", F.array(token("D", F.floor(i / 3)))).withColumn("party_tokens", F.array(token("A", F.floor(i / 6)), token("B", F.col("source"))))
    existing, others = rows.where("item_id % 5 = 0"), rows.where("item_id % 5 <> 0")
    why = F.when(i % 21 == 0, "").otherwise("off topic").alias("reason")
    screen = others.where("item_id % 12 <> 0").select("item_id", (i % 6 != 0).alias("passes"), why)
    triage = others.select("item_id", (i % 7 != 0).alias("passes"), why)
    smells = others.where("item_id % 4 in (1, 2)").select("item_id", F.when(i % 4 == 1, "suspect").otherwise("ok").alias("verdict"))
    tried = others.select(i.alias("item"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("attempt"))
    vote = lambda k, flags: F.when(k == 0, "lost").when(k.isin(flags), "flag").otherwise("clear").alias("vote")
    guards = {
        "fidelity": tried.select("item", "attempt", vote(F.col("item") * F.col("attempt") % 5, [1, 2]), F.lit("r").alias("reason")),
        "completeness": tried.select("item", "attempt", vote((F.col("item") + F.col("attempt")) % 4, [1]), F.lit("r").alias("reason")),
    }
    return J.funnel_run(
        rows, [existing.select("item_id")], existing, "2024-03-01", "2024-12-31", ["src3"], [("screen", screen), ("triage", triage)],
        smells=smells, validity={"low_confidence": F.length("text") < 700, "unverified_date": i % 9 == 0}, guards=guards,
        reads=others.where("item_id % 9 <> 0").select("item_id", (i % 5 != 1).alias("passes")), overruling=others.where("item_id % 10 = 1"), cleared=others.where("item_id % 4 = 3"), seen=existing.select("item_id"),
    )


@query("j1_funnel", f"""{RUN} SELECT source, CASE WHEN fate IS NULL THEN lane ELSE concat_ws(': ', fate, smell, outcome) END AS stage, count(*) AS n FROM r GROUP BY 1, 2
    UNION ALL SELECT source, 'floored', floored FROM l""", "cand")
def j1(spark, d):
    return J.funnel_counts(run(spark, d))


@query("j1_smells", f"""{RUN} SELECT item_id, smell, outcome AS smell_outcome FROM r WHERE smell IS NOT NULL""", "cand")
def j1_smells(spark, d):
    return run(spark, d).smells


@query("j1_seen", f"""{RUN} SELECT item_id FROM (SELECT item_id FROM b WHERE known UNION SELECT item_id FROM r WHERE fate IN ('duplicate', 'screen', 'triage') OR fate IS NULL AND lane = 'auto')
    ORDER BY item_id DESC LIMIT 5000""", "cand")
def j1_seen(spark, d):
    return run(spark, d).seen


@query("j1_run_record", f"""{RUN} SELECT (SELECT count(*) FROM r) AS screened, (SELECT count(fate) FROM r) AS dropped, (SELECT count(*) - count(fate) FROM r) AS carded,
    (SELECT string_agg(fate || '=' || n, ',' ORDER BY fate) FROM (SELECT fate, count(*) AS n FROM r WHERE fate IS NOT NULL GROUP BY 1)) AS drops,
    (SELECT string_agg(source || '=' || floored, ',' ORDER BY source) FROM l) AS floors""", "cand")
def j1_run_record(spark, d):
    shown = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias(c)
    return run(spark, d).record.select("screened", "dropped", "carded", shown("drops"), shown("floors"))


@query("j2_treatment_sweep")
def j2(spark, d):
    rows = items(spark, d).withColumn("full_at", F.when(F.col("item_id") % 2 == 1, F.col("date"))).withColumn("name", F.concat_ws(" v. ", "source", "raw_status"))
    e = edges(spark, d)
    docs = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("item_id")).agg(F.concat_ws(" ", F.array_sort(F.collect_set("l_linestatus")), F.lit("urgent high matter")).alias("text")).where("item_id % 3 <> 0")
    pair = e.select(F.col("dst_id").alias("item_id"), F.col("src_id").alias("citer_id"), "kind")
    verdicts = pair.groupBy("item_id", "citer_id").agg(F.max("kind").alias("kind")).withColumn("affects", F.col("citer_id") % 2 == 0)
    none = pair.select("item_id", "citer_id").limit(0)
    out = J.treatment_sweep(rows, e, docs, none, pair.where("citer_id % 997 = 1").select("item_id", "citer_id", F.lit(0).alias("tries"), F.lit(None).cast("date").alias("text_since")).distinct(), verdicts, "2001-08-01", False, ["criticized", "overruled"], per_run=500)
    return out["pending"].select("item_id", "citer_id", "tries", "action")


@query("j3_page_watch")
def j3(spark, d):
    pages = table(spark, d, "pages").withColumn("title", F.regexp_extract("html", "<title>([^<]*)", 1))
    state = pages.where("page_id % 3 <> 0").select("url", F.lit("old").alias("hash"))
    existing = spark.createDataFrame([], "stable_key string, canonical string, url string, first_seen date")
    return J.page_watch(pages, state, existing, "the", ["and", "que", "of"])["items"].select("stable_key", "canonical", "action")


REGISTRY = """, p AS (SELECT *, year(date) >= 2000 OR year(date) = 1995 AS here, item_id % 10 = 0 AND (year(date) + 1 >= 2000 OR year(date) + 1 = 1995) AS later FROM items),
    m AS (SELECT *, source IN ('1-URGENT', '2-HIGH') AS wanted, CASE WHEN item_id % 7 = 0 AND NOT later OR item_id % 4 = 0 THEN 'escalated' WHEN item_id % 4 IN (1, 2) THEN 'ok' ELSE 'error' END AS recall
        FROM p WHERE (here OR later) AND status IN ('ok', 'caution') AND NOT starts_with(source, '5') AND (item_id % 3 <> 0 OR later))"""


def registry(spark, d):
    """Orders as registry records: a list per year and 500 ids; every tenth record is listed again, changed, a year later."""
    i = F.col("item_id")
    rows = items(spark, d).withColumn("token", F.col("token").cast("string")).withColumn("number", F.col("source")).withColumn("title", F.concat_ws(" ", "source", "raw_status")).withColumn("period_id", F.year("date"))
    again = rows.where("item_id % 10 = 0").withColumn("token", F.lit("x")).withColumn("period_id", F.col("period_id") + 1)
    listed = rows.union(again)
    entry = F.struct(i.cast("string"), F.struct("item_id", "status", "number", "token", "title"))
    head = F.create_map(F.lit("session"), F.struct(F.lit(0).cast("long").alias("item_id"), *(F.lit("meta").alias(c) for c in ("status", "number", "token", "title"))))
    maps = listed.groupBy("period_id", F.floor(i / 500)).agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    lists = maps.select("period_id", F.to_json(F.struct(F.map_concat("m", head).alias("masterlist"))).alias("payload"))
    periods = listed.select("period_id", F.when(F.col("period_id") == 1995, "n/a").otherwise(F.col("period_id").cast("string")).alias("last_year")).distinct()
    audits = listed.where("item_id % 4 <> 3").select("item_id", "token", (i % 4 == 0).alias("suspect"))
    logged = rows.where("item_id % 7 = 0").select("item_id", "token", F.explode(F.array_repeat(F.lit("error"), 3)).alias("recall"))
    requests = rows.where("item_id % 2 = 0").select(i.alias("request_id"), "item_id", F.col("token").alias("content_hash"), (F.col("custkey") % 40).alias("age"))
    results = requests.where("item_id % 6 <> 0").select("request_id", "item_id", "content_hash", F.when(i % 5 == 0, "drop").otherwise("keep").alias("verdict"))
    return J.registry_watch(
        lists, periods, "item_id LONG, status STRING, number STRING, token STRING, title STRING", 2001, rows.where("item_id % 3 = 0").select("item_id", "token"),
        rows.where("item_id % 8 = 0").select("item_id", "status", "token", "first_seen"), requests, results, audits, logged,
        statuses=["ok", "caution"], excluded_prefix="5", words=["urgent", "high"], max_age=25,
    )


@query("j4_registry_watch", f"""{REGISTRY}, n AS (SELECT item_id FROM m WHERE (wanted OR recall = 'escalated') AND item_id % 2 = 0 AND item_id % 3 <> 0 AND item_id % 5 <> 0)
    SELECT coalesce(n.item_id, e.item_id) AS item_id, CASE WHEN e.item_id IS NULL THEN 'added' WHEN n.item_id IS NULL THEN 'kept' ELSE 'updated' END AS action
    FROM n FULL JOIN (SELECT item_id FROM items WHERE item_id % 8 = 0) e ON e.item_id = n.item_id""", "items")
def j4(spark, d):
    return registry(spark, d)["items"].select("item_id", "action")


@query("j4_drop_audit", f"{REGISTRY} SELECT item_id, recall FROM m WHERE NOT wanted", "items")
def j4_drop_audit(spark, d):
    return registry(spark, d)["drops"].select("item_id", "recall")


@query("j4_seen", f"""{REGISTRY} SELECT item_id FROM items WHERE item_id % 3 = 0 UNION SELECT item_id FROM m WHERE NOT wanted AND recall = 'ok' OR (wanted OR recall = 'escalated') AND item_id % 2 = 0 AND item_id % 3 <> 0""", "items")
def j4_seen(spark, d):
    return registry(spark, d)["seen"].select("item_id")


@query("j5_immutable_watch", """SELECT coalesce(n.item_id, e.item_id) AS item_id, CASE WHEN e.item_id IS NULL THEN 'added' WHEN n.item_id IS NULL THEN 'kept' ELSE 'updated' END AS action
    FROM (SELECT item_id FROM items WHERE date >= DATE '2001-08-01' - 45 AND item_id % 5 <> 0 AND source = '1-URGENT') n FULL JOIN (SELECT item_id FROM items WHERE item_id % 4 = 0) e ON e.item_id = n.item_id""", "items")
def j5(spark, d):
    rows = items(spark, d).select("item_id", "source", "date", "first_seen")
    return J.immutable_watch(rows, rows.where("item_id % 5 = 0").select("item_id"), rows.where("item_id % 4 = 0"), "2001-08-01", F.col("source") == "1-URGENT").select("item_id", "action")


@query("j6_log_lint")
def j6(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("lang").alias("stage"), "source", F.col("source").alias("category"), F.col("text").alias("reason"), F.col("source").alias("name"), F.lit(None).cast("string").alias("docket"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("evidence"))
    allowed = spark.createDataFrame([("en", f"src{k}") for k in range(10)], "stage string, category string")
    return J.log_lint(rows, allowed, spark.createDataFrame([("the",)], "phrase string"), "license|token")


@query("j7_guard_revalidate", """WITH o AS (SELECT conv_id AS item_id, count(*) FILTER (role = 'user') AS flags, count(*) FILTER (role = 'assistant') AS clears, row_number() OVER (ORDER BY conv_id) - 1 AS place, count(*) OVER () AS n FROM conversations GROUP BY 1)
    SELECT item_id, CASE WHEN flags > 2 THEN 'flagged' WHEN clears > 2 THEN 'ok' ELSE 'undecided' END AS outcome FROM o WHERE (place - 20001 * 30 % n + n) % n < 30""")
def j7(spark, d):
    vote = F.when(F.col("role") == "user", "flag").when(F.col("role") == "assistant", "clear").otherwise("lost")
    attempts = table(spark, d, "conversations").select(F.col("conv_id").alias("item"), F.col("turn").alias("attempt"), vote.alias("vote"), F.lit("r").alias("reason"))
    return J.guard_revalidate(attempts.select(F.col("item").alias("item_id")).distinct(), attempts, 30, 20_001, 5)[0]


@query("j8_backfill_sweep", """, o AS (SELECT item_id, source, text, item_id // 2 AS docket, item_id % 3 AS holdings FROM cand WHERE date BETWEEN DATE '2024-02-01' AND DATE '2024-11-30'),
    u AS (SELECT *, row_number() OVER (PARTITION BY source, docket ORDER BY holdings DESC, item_id) AS n, length(text) >= 500 AND length(regexp_replace(text, '[^\\p{L}]', '', 'g')) >= 100 AS ok FROM o),
    r AS (SELECT CASE WHEN n > 1 THEN 'duplicate' WHEN NOT coalesce(ok, false) OR item_id % 6 = 0 OR item_id % 7 = 0 THEN 'dropped' ELSE 'carded' END AS status,
        CASE WHEN n > 1 THEN 'identity' WHEN NOT coalesce(ok, false) THEN 'text' WHEN item_id % 12 = 0 THEN 'screen: retry' WHEN item_id % 6 = 0 THEN 'screen' WHEN item_id % 7 = 0 THEN 'triage' ELSE 'all' END AS tier FROM u)
    SELECT status, tier, count(*) AS n FROM r GROUP BY GROUPING SETS ((status, tier), (status))""".replace(", o AS", "SELECT * FROM (WITH o AS", 1) + ")", "cand")
def j8(spark, d):
    i = F.col("item_id")
    rows = cand(spark, d).withColumns({"name": F.lit("x"), "docket_tokens": F.array(F.concat(F.lit("D"), F.floor(i / 2).cast("string"))), "holdings": i % 3})
    return J.backfill_sweep(rows, [], "2024-02-01", "2024-11-30", tiers(rows))


@query("s1_stream_candidates", f""", {TIERS} SELECT item_id, source FROM g WHERE stage = 'carded'""".replace(", t AS", "SELECT * FROM (WITH t AS", 1) + ")", "cand")
def s1(spark, d):
    rows = cand(spark, d)
    source = S.file_stream(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "source", F.col("lang").alias("jurisdiction"), F.col("doc_id").alias("ingest_seq"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias("date"), "text")
    known = [rows.where("item_id % 5 = 0").select("item_id")]
    return S.stream_batches(source, lambda batch, state: J.funnel(batch, known + ([state.select("item_id")] if state is not None else []), "2024-03-01", "2024-12-31", ["src3"], tiers(rows)).kept.select("item_id", "source"))


@query("s2_stream_dedup", "SELECT DISTINCT user_id AS item_id FROM events WHERE user_id % 5 <> 0")
def s2(spark, d):
    seen = table(spark, d, "events").where("user_id % 5 = 0").select(F.col("user_id").alias("item_id")).distinct()
    rows = S.file_stream(spark, d, "events").select(F.col("user_id").alias("item_id"), F.col("ts").cast("timestamp").alias("ts"))
    return S.drain(S.stream_dedup(rows, "item_id", "ts", "60 days", seen)).select("item_id")


@query("s3_stream_usage", """WITH m AS (SELECT user_id, time_bucket(INTERVAL 1 MINUTE, ts) AS pane, count(*) AS n FROM events GROUP BY ALL), w AS (SELECT user_id, pane - to_minutes(unnest(range(60))) AS start, n FROM m)
    SELECT CAST(start AS VARCHAR) AS start, CAST(start + INTERVAL 1 HOUR AS VARCHAR) AS "end", user_id, CAST(sum(n) AS BIGINT) AS calls FROM w WHERE start + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) GROUP BY ALL""")
def s3(spark, d):
    rows = S.file_stream(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return S.usage_windows(S.drain(S.stream_usage(rows, "user_id", "ts")), "user_id").select(*text("start", "end"), "user_id", "calls")


@query("s4_stream_digest", """SELECT CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS week, event_type AS kind, count(*) AS n FROM events WHERE date_trunc('week', ts) + INTERVAL 14 DAY <= (SELECT max(ts) FROM events) GROUP BY ALL""")
def s4(spark, d):
    rows = S.file_stream(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    return S.drain(S.stream_digest(rows, "kind", "ts", "7 days")).select(*text("week"), "kind", "n")


@query("s5_stream_two_strike")
def s5(spark, d):
    rows = S.file_stream(spark, d, "events").select(F.col("user_id").cast("string").alias("url"), (F.col("event_type") == "error").alias("failed"), F.col("ts").cast("timestamp").alias("ts"))
    return S.drain(S.stream_two_strike(rows))


@query("s6_stream_staleness")
def s6(spark, d):
    rows = S.file_stream(spark, d, "events").select(F.col("user_id").cast("string").alias("source"), F.col("ts").cast("timestamp").alias("ts"))
    return S.drain(S.stream_staleness(rows, 36))


@query("s7_stream_late_verdicts")
def s7(spark, d):
    rows = S.file_stream(spark, d, "events").select(F.col("event_id").alias("item_id"), F.col("user_id").cast("string").alias("content_hash"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    results = S.file_stream(spark, d, "events").where("event_id % 3 = 0").select(F.col("event_id").alias("item_id"), F.col("user_id").cast("string").alias("content_hash"), (F.col("ts").cast("timestamp") + F.expr("interval 1 day")).alias("ts"), F.col("event_type").alias("verdict"))
    return S.drain(S.stream_late_verdicts(rows, results, 25))


@query("s8_stream_changes", """SELECT item_id, CAST(CASE WHEN treatment_date > first_seen THEN treatment_date ELSE first_seen END AS VARCHAR) AS changed, CASE WHEN treatment_date > first_seen THEN 'treatment' ELSE 'new' END AS change FROM items""", "items")
def s8(spark, d):
    day = F.col("o_orderdate").cast("date")
    rows = S.file_stream(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), day.alias("date"), F.date_add(day, (F.col("o_orderkey") % 10).cast("int")).alias("first_seen"), F.when(F.col("o_orderstatus") != "O", F.date_add(day, (F.col("o_custkey") % 400).cast("int"))).alias("treatment_date"))
    return S.drain(G.change_event(rows).select("item_id", *text("changed"), "change"))


@query("s9_stream_page_watch", "SELECT url, 'changed' AS outcome FROM pages WHERE contains(lower(html), 'the ')")
def s9(spark, d):
    from docwatch.functions.text import fingerprint_pages

    rows = fingerprint_pages(S.file_stream(spark, d, "pages"), "html", "<", ["the "]).select("url", F.col("content_hash").alias("hash"), "is_shell", F.lit(True).alias("extracted"))
    return S.stream_page_watch(rows).where("outcome = 'changed'").select("url", "outcome")
