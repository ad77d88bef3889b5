"""Queries of sources, column transforms and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from docwatch.functions import text as T
from docwatch.functions import values
from docwatch.operators import select as S
from docwatch.plans.roles import cand, edges, golden, items, log, query, table, text
from docwatch.sources import feeds

LICENSE, EMAIL = r"([A-Za-z]+ [Ll]icense)", r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9])"
IPV4 = r"([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})"


@query("a8_html_to_text")
def a8(spark, d):
    return T.html_to_text(table(spark, d, "pages"), "html").select("page_id", "page_text")


@query("a9_text_quality_gate", r"SELECT doc_id FROM documents WHERE length(text) >= 500 AND length(regexp_replace(text, '[^\p{L}]', '', 'g')) >= 100")
def a9(spark, d):
    return T.text_quality_gate(table(spark, d, "documents"), "text").select("doc_id")


@query("a10_release_index")
def a10(spark, d):
    return feeds.release_index(table(spark, d, "pages"), "page_id", "html")


@query("a11_extract_links", """SELECT DISTINCT page_id, href FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)
    WHERE href <> '' AND NOT starts_with(lower(href), '#') AND NOT starts_with(lower(href), 'mailto:') AND NOT starts_with(lower(href), 'javascript:') AND NOT starts_with(lower(href), 'data:')""")
def a11(spark, d):
    return feeds.extract_links(table(spark, d, "pages"), "page_id", "html")


@query("a12_slices", """, known AS (SELECT DISTINCT lang AS area FROM documents UNION ALL SELECT 'none'),
    r AS (SELECT jurisdiction AS area, item_id, row_number() OVER (PARTITION BY jurisdiction ORDER BY date DESC, item_id DESC) AS position FROM cand)
    SELECT area, item_id, position, n FROM known LEFT JOIN r USING (area) LEFT JOIN (SELECT area, count(*) AS n0 FROM r GROUP BY 1) USING (area), LATERAL (SELECT coalesce(n0, 0) AS n)""".replace(", known", "SELECT * FROM (WITH known", 1) + ")", "cand")
def a12(spark, d):
    known = table(spark, d, "documents").select(F.col("lang").alias("area")).distinct().union(spark.sql("select 'none'"))
    rows, counts = feeds.slices(cand(spark, d).withColumn("areas", F.array("jurisdiction")), "areas", known, [F.desc("date"), F.desc("item_id")])
    return counts.join(rows.select("area", "item_id", F.col("position").cast("long").alias("position")), "area", "left").select("area", "item_id", "position", "n")


@query("a13_append_bounded", "SELECT seq, stage FROM (SELECT * FROM log UNION ALL SELECT seq + 1000000, source, stage, ts, value, k FROM log WHERE seq % 7 = 0) ORDER BY seq DESC LIMIT 5000", "log")
def a13(spark, d):
    old = log(spark, d)
    return feeds.append_bounded(old, old.where("seq % 7 = 0").withColumn("seq", F.col("seq") + 1_000_000), "seq", 5000).select("seq", "stage")


TOKENS = r"list_sort(list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda t: length(t) >= 3 AND NOT regexp_full_match(t, '[0-9]+') AND t NOT IN ({}))))"
STOPS = ", ".join(f"'{w}'" for w in values.NAME_STOP)


@query("t1_normalize_items", f"""SELECT p_partkey AS item_id, array_to_string({TOKENS.format('p_name', STOPS)}, ',') AS party_tokens,
    trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS name_key,
    array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(p_type, '[^A-Za-z0-9-]+'), lambda t: upper(t)), lambda t: length(t) >= 4))), ',') AS docket_tokens FROM part""")
def t1(spark, d):
    rows = table(spark, d, "part").withColumns({"raw": F.col("p_partkey").cast("string"), "url": F.lit(None).cast("string"), "day": F.lit(None).cast("string")})
    out = T.normalize_items(rows, "raw", "url", "day", "p_type", "p_name")
    return out.select("item_id", F.array_join(F.array_sort("party_tokens"), ",").alias("party_tokens"), "name_key", F.array_join(F.array_sort("docket_tokens"), ",").alias("docket_tokens"))


CLIP_BODY = 3000 - len(values.CLIP_MARKER)
CLIP_AT = CLIP_BODY * values.CLIP_HEAD // 100


@query("t2_clip_texts", f"""SELECT doc_id, CASE WHEN length(text) > 3000 THEN substr(text, 1, {CLIP_AT}) || '{values.CLIP_MARKER}' || substr(text, length(text) - {CLIP_BODY - CLIP_AT} + 1) ELSE text END AS clipped FROM documents""")
def t2(spark, d):
    return T.clip_texts(table(spark, d, "documents"), "text", 3000).select("doc_id", "clipped")


@query("t4_lint_reasons", """SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), 'license|token|the|may'))), ',') AS hedges,
    array_to_string(list_sort(list_distinct(regexp_extract_all(text, '"([^"]{2,60})"', 1))), ',') AS quotes FROM documents""")
def t4(spark, d):
    out = T.lint_reasons(table(spark, d, "documents"), "text", "license|token|the|may")
    return out.select("doc_id", F.array_join("hedges", ",").alias("hedges"), F.array_join("quotes", ",").alias("quotes"))


@query("t5_extract_references", r"""SELECT DISTINCT doc_id, kind, trim(reference) AS reference FROM (
    SELECT doc_id, 'email' AS kind, unnest(regexp_extract_all(text, '([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9])', 1)) AS reference FROM documents UNION ALL
    SELECT doc_id, 'ipv4', unnest(regexp_extract_all(text, '([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})', 1)) FROM documents UNION ALL
    SELECT doc_id, 'license', unnest(regexp_extract_all(text, '([A-Za-z]+ [Ll]icense)', 1)) FROM documents)""")
def t5(spark, d):
    patterns = {"email": ("", EMAIL), "ipv4": ("", IPV4), "license": ("", LICENSE)}
    return T.extract_references(table(spark, d, "documents"), "doc_id", "text", patterns)


RULES = [("lang", "the"), ("lang", "que"), ("law", "license"), ("law", "copyright"), ("secret", "token"), ("abuse", "idiot"), ("abuse", "moron")]
RULE_SQL = "(VALUES " + ", ".join(f"('{t}', '{k}')" for t, k in RULES) + ") AS rules(tag, keyword)"


@query("t6_tag_documents", f"SELECT doc_id, array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags FROM documents JOIN {RULE_SQL} ON contains(lower(text), keyword) GROUP BY doc_id")
def t6(spark, d):
    out = T.tag_documents(table(spark, d, "documents"), "doc_id", "text", spark.createDataFrame(RULES, "tag string, keyword string"))
    return out.select("doc_id", F.array_join("tags", ",").alias("tags"))


@query("t7_calendar_keys", "SELECT event_id, CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS week FROM events")
def t7(spark, d):
    return T.calendar_keys(table(spark, d, "events"), "ts").select("event_id", *text("week"))


@query("t8_bucket_outcomes", "SELECT o_orderkey, CASE WHEN contains(lower(o_orderpriority), 'urgent') THEN 'now' WHEN contains(lower(o_orderpriority), 'high') THEN 'soon' WHEN contains(lower(o_orderpriority), 'low') THEN 'later' ELSE 'other' END AS bucket FROM orders")
def t8(spark, d):
    return T.bucket_outcomes(table(spark, d, "orders"), "o_orderpriority", [("urgent", "now"), ("high", "soon"), ("low", "later")]).select("o_orderkey", "bucket")


@query("t9_vet_urls", """SELECT page_id, CASE WHEN NOT regexp_matches(u, '^https?://') THEN 'scheme' WHEN contains(regexp_extract(u, '^[A-Za-z]+://([^/?#]*)', 1), '@') THEN 'credentials'
    WHEN regexp_replace(regexp_extract(u, '^[A-Za-z]+://([^/?#]*)', 1), ':[0-9]*$', '') = '' THEN 'host' END AS url_reason, regexp_replace(u, '^http://', 'https://') AS safe_url FROM (SELECT page_id, trim(url) AS u FROM pages)""")
def t9(spark, d):
    return T.vet_urls(table(spark, d, "pages"), "url").select("page_id", "url_reason", "safe_url")


@query("t11_reference_labels", """SELECT l_orderkey, string_agg(t || ' CFR ' || p, '; ' ORDER BY t) AS label FROM (SELECT l_orderkey, l_suppkey AS t, array_to_string(list_sort(list(DISTINCT l_partkey)), ', ') AS p FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def t11(spark, d):
    return T.reference_labels(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey", "l_partkey")


@query("t12_fingerprint_pages", "SELECT page_id, sha256(html) AS content_hash, NOT (contains(lower(html), 'title') AND (contains(lower(html), 'the ') OR contains(lower(html), 'que '))) AS is_shell FROM pages")
def t12(spark, d):
    return T.fingerprint_pages(table(spark, d, "pages"), "html", "title", ["the ", "que "]).select("page_id", "content_hash", "is_shell")


@query("c1_select_candidates", """, fresh AS (SELECT * FROM items WHERE item_id % 5 <> 0 AND item_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)),
    ok AS (SELECT *, (date <= DATE '2000-12-31' AND (date >= DATE '1998-06-01' OR source = '1-URGENT')) AS p FROM fresh)
    SELECT 'chosen' AS kind, item_id, source, CAST(NULL AS BIGINT) AS floored FROM ok WHERE p UNION ALL
    SELECT 'lost', NULL, source, count(DISTINCT item_id) FROM ok WHERE NOT p AND date <= DATE '2000-12-31' GROUP BY source""".replace(", fresh", "SELECT * FROM (WITH fresh", 1) + ")", "items")
def c1(spark, d):
    rows = items(spark, d).withColumn("ingest_seq", F.col("item_id"))
    known = [rows.where("item_id % 5 = 0").select("item_id"), table(spark, d, "customer").where("c_custkey % 3 = 0").select("c_custkey")]
    chosen, lost = S.select_candidates(rows, known, "1998-06-01", "2000-12-31", ["1-URGENT"])
    none = F.lit(None).cast("long")
    return chosen.select(F.lit("chosen").alias("kind"), "item_id", "source", none.alias("floored")).union(lost.select(F.lit("lost"), none, "source", "floored"))


@query("c2_admit_backlog", """SELECT item_id, row_number() OVER (ORDER BY item_id) <= 40 AS admitted FROM items WHERE item_id > 500 AND date < DATE '1996-01-01' AND item_id % 5 <> 0""", "items")
def c2(spark, d):
    rows = items(spark, d)
    a, w = S.admit_backlog(rows, 500, "1996-01-01", [rows.where("item_id % 5 = 0").select("item_id")], 40)
    return a.select("item_id", F.lit(True).alias("admitted")).union(w.select("item_id", F.lit(False)))


@query("c3_moved_records", """SELECT item_id, item_id % 3 <> 0 AS is_new FROM items WHERE status IN ('ok', 'caution') AND NOT starts_with(source, '5') AND (item_id % 3 <> 0 OR item_id % 2 = 0)""", "items")
def c3(spark, d):
    rows = items(spark, d).withColumn("number", F.col("source"))
    seen = rows.where("item_id % 3 = 0").select("item_id", F.when(F.col("item_id") % 2 == 0, F.col("token") + 1).otherwise(F.col("token")).alias("token"))
    return S.moved_records(rows, seen, ["ok", "caution"], "5").select("item_id", "is_new")


@query("c4_new_records", "SELECT item_id FROM items WHERE item_id % 5 <> 0", "items")
def c4(spark, d):
    rows = items(spark, d)
    return S.without(rows, "item_id", rows.where("item_id % 5 = 0").select("item_id")).select("item_id")


@query("c5_active_periods", "SELECT item_id, year_to FROM (SELECT item_id, CASE WHEN item_id % 50 = 0 THEN 'n/a' ELSE CAST(year(date) AS VARCHAR) END AS year_to FROM items) WHERE coalesce(TRY_CAST(year_to AS INTEGER) >= 2000, true)", "items")
def c5(spark, d):
    rows = items(spark, d).withColumn("year_to", F.when(F.col("item_id") % 50 == 0, "n/a").otherwise(F.year("date").cast("string")))
    return S.active_periods(rows, "year_to", 2001, "item_id").select("item_id", "year_to")


@query("c7_display_window", "SELECT item_id, date >= DATE '1998-02-28' AS in_window FROM items", "items")
def c7(spark, d):
    return S.display_window(items(spark, d), "date", "2000-02-29").select("item_id", "in_window")


FEED = """SELECT item_id, source, status, CASE WHEN treatment_date > first_seen THEN treatment_date ELSE first_seen END AS changed, CASE WHEN treatment_date > first_seen THEN 'treatment' ELSE 'new' END AS change FROM items"""


@query("c8_whats_new", f"""SELECT item_id, CAST(changed AS VARCHAR) AS changed, total, total > 150 AS has_more FROM (SELECT *, count(*) OVER () AS total FROM ({FEED}) WHERE changed > DATE '1999-01-01' AND change = 'treatment' AND source IN ('1-URGENT', '2-HIGH'))
    ORDER BY changed DESC, item_id DESC LIMIT 50 OFFSET 100""", "items")
def c8(spark, d):
    from docwatch.operators.state import change_event

    feed = change_event(items(spark, d)).withColumn("areas", F.array("source")).withColumn("kind", F.col("change"))
    page, one = S.whats_new(feed, "1999-01-01", ["treatment"], ["1-URGENT", "2-HIGH"], 100, 50)
    return page.select("item_id", *text("changed")).join(F.broadcast(one))  # one row


@query("c8_area_coverage", f"""SELECT lower(area) AS area, count(*) AS n FROM (SELECT item_id, unnest(list_distinct([source, CASE WHEN item_id % 3 = 0 THEN status END])) AS area FROM ({FEED})) WHERE area IS NOT NULL GROUP BY 1""", "items")
def c8b(spark, d):
    from docwatch.operators.state import change_event

    areas = F.array_compact(F.array("source", F.when(F.col("item_id") % 3 == 0, F.col("status"))))
    return S.area_coverage(change_event(items(spark, d)).withColumn("areas", areas))


@query("c9_rotating_slice", "SELECT s_suppkey FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS r, count(*) OVER () AS n FROM supplier) WHERE (r - (20001 * 7) % n + n) % n < 7")
def c9(spark, d):
    return S.rotating_slice(table(spark, d, "supplier"), "s_suppkey", 7, 20001).select("s_suppkey")


@query("c10_escalate_suspects", """, d AS (SELECT doc_id AS item_id, CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE 'x' END AS reason, CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' END AS v FROM documents LEFT JOIN labels USING (doc_id)),
    s AS (SELECT item_id, CASE WHEN trim(reason) = '' THEN 'suspect' ELSE v END AS smell, row_number() OVER (PARTITION BY trim(reason) = '' ORDER BY item_id) AS r FROM d)
    SELECT item_id, CASE WHEN smell = 'suspect' AND r > 60 THEN 'capped' ELSE smell END AS smell FROM s""".replace(", d AS", "WITH d AS", 1))
def c10(spark, d):
    drops = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.when(F.col("doc_id") % 4 == 0, " ").otherwise("x").alias("reason"), F.col("doc_id").alias("seq"))
    verdicts = table(spark, d, "labels").select(F.col("doc_id").alias("item_id"), F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").alias("verdict"))
    return S.escalate_suspects(drops, verdicts, 60).select("item_id", "smell")


@query("c11_select_for_audit", """SELECT seq, stage FROM log WHERE stage IN ('click', 'view') AND (k % 3 = 0 OR k % 3 = 1) AND NOT (seq % 4 = 0) ORDER BY seq DESC LIMIT 200""", "log")
def c11(spark, d):
    rows = log(spark, d).withColumns({"smell": F.when(F.col("k") % 3 != 0, "s"), "smell_outcome": F.when(F.col("k") % 3 == 1, "deferred"), "audit_depth": F.when(F.col("seq") % 4 == 0, "full").when(F.col("seq") % 4 == 1, "skim")})
    return S.select_for_audit(rows, ["click", "view"], 200).select("seq", "stage")


@query("c12_abandoned_due", "SELECT item_id, CAST(first_seen AS VARCHAR) AS last_try FROM items WHERE first_seen <= DATE '1999-12-02' AND item_id % 5 <> 0 ORDER BY first_seen, item_id LIMIT 80", "items")
def c12(spark, d):
    rows = items(spark, d).withColumn("last_try", F.col("first_seen"))
    return S.abandoned_due(rows, [rows.where("item_id % 5 = 0").select("item_id")], "2000-01-01", 30, 80).select("item_id", *text("last_try"))


@query("c14_closed_category_check", "SELECT seq, (stage = 'click' AND k % 4 NOT IN (0, 1)) OR (stage = 'error' AND k % 4 <> 2) AS category_invalid FROM log", "log")
def c14(spark, d):
    allowed = spark.createDataFrame([("click", "c0"), ("click", "c1"), ("error", "c2")], "stage string, category string")
    rows = log(spark, d).withColumn("category", F.concat(F.lit("c"), (F.col("k") % 4).cast("string")))
    return S.closed_category_check(rows, allowed).select("seq", "category_invalid")


@query("c15_validity_flags", r"""SELECT doc_id, array_to_string(list_sort(list_filter([CASE WHEN length(text) < 500 THEN 'low_confidence' END, CASE WHEN regexp_matches(text, '[0-9]{4}') THEN 'citation_present' END,
    CASE WHEN trim(text) = '' THEN 'empty_text' END, CASE WHEN doc_id % 9 = 0 THEN 'unverified_date' END], lambda x: x IS NOT NULL)), ',') AS flags FROM documents""")
def c15(spark, d):
    flags = S.reasons(low_confidence=F.length("text") < 500, citation_present=F.col("text").rlike("[0-9]{4}"), empty_text=F.trim("text") == "", unverified_date=F.col("doc_id") % 9 == 0)
    return table(spark, d, "documents").select("doc_id", F.array_join(flags, ",").alias("flags"))


@query("c16_flagged", "SELECT item_id, status, CAST(coalesce(treatment_date, date) AS VARCHAR) AS flag_date FROM items WHERE status <> 'ok'", "items")
def c16(spark, d):
    return S.flagged(items(spark, d)).select("item_id", "status", *text("flag_date"))


@query("c17_digest_select", """SELECT 'new' AS section, item_id, CAST(first_seen AS VARCHAR) AS day FROM items WHERE first_seen >= DATE '2001-06-02' UNION ALL
    SELECT 'correction', item_id, CAST(treatment_date AS VARCHAR) FROM items WHERE status <> 'ok' AND treatment_date >= DATE '2001-06-02'""", "items")
def c17(spark, d):
    return S.digest_select(items(spark, d), "2001-07-02", 30).select("section", "item_id", *text("day"))


@query("c17_digest_watches", "SELECT source AS kind, count(*) AS n FROM items WHERE first_seen >= DATE '2001-06-02' GROUP BY 1", "items")
def c17b(spark, d):
    return S.digest_watches(items(spark, d).withColumnRenamed("source", "kind"), "2001-07-02", 30)


@query("f1_ordered", "SELECT item_id, CAST(date AS VARCHAR) AS date FROM items", "items")
def f1(spark, d):
    return S.ordered(items(spark, d)).select("item_id", *text("date"))


@query("f2_cap_per_group", """SELECT dst_id, src_id, line FROM (SELECT *, row_number() OVER (PARTITION BY dst_id ORDER BY ts DESC, src_id DESC, line) AS r FROM edges) WHERE r <= 3 ORDER BY ts DESC, src_id DESC, line, dst_id LIMIT 250""", "edges")
def f2(spark, d):
    order = [F.desc("ts"), F.desc("src_id"), "line", "dst_id"]
    return S.cap_per_group(edges(spark, d), "dst_id", 3, 250, *order).select("dst_id", "src_id", "line")


@query("f6_set_ops", "SELECT item_id FROM ((SELECT item_id FROM items WHERE item_id % 5 = 0 UNION SELECT item_id FROM items WHERE item_id % 7 = 0) EXCEPT SELECT c_custkey FROM customer)", "items")
def f6(spark, d):
    rows = items(spark, d).select("item_id")
    return S.without(S.union_ids(rows.where("item_id % 5 = 0"), rows.where("item_id % 7 = 0")), "item_id", table(spark, d, "customer").select("c_custkey"))
