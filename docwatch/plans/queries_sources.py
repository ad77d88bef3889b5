"""Queries of payload sources and row assembly, over payloads that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docwatch.functions import text as T
from docwatch.functions import values
from docwatch.plans.roles import line_order, query, table, text
from docwatch.sources import feeds
from docwatch.streaming.streams import work_folder


FEED_PAGES = """WITH p AS (SELECT page_id, page_id // 50 AS part, 'https://' || CASE page_id % 5 WHEN 1 THEN 'www.site.org.evil.com' WHEN 2 THEN 'SITE.org' ELSE 'www.site.org' END AS host,
    '/opinion/' || page_id || '/x' AS path FROM pages)"""


def feed_folder(spark, d):
    """Pages as feed files of 50 entries, of which the third of every seven declares a DTD and the last breaks off."""
    i, part = F.col("page_id").cast("string"), F.floor(F.col("page_id") / 50)
    day = F.when(F.col("page_id") % 4 != 0, F.concat(F.lit("<published>2024-01-0"), (1 + F.col("page_id") % 9).cast("string"), F.lit("T00:00:00Z</published>"))).otherwise("")
    host = F.when(F.col("page_id") % 5 == 1, "www.site.org.evil.com").when(F.col("page_id") % 5 == 2, "SITE.org").otherwise("www.site.org")
    where = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("/opinion/"), i, F.lit("/x"))).otherwise("/none")
    entry = F.concat(F.lit("<entry><title>page "), i, F.lit('</title><link rel="alternate" href="https://'), host, where, F.lit('"/>'), day, F.lit("<summary>s</summary></entry>"))
    body = F.array_join(F.collect_list("e"), "")
    head = F.when(F.col("part") % 7 == 2, "<!DOCTYPE feed>").otherwise("")
    tail = F.when(F.col("part") % 7 == 6, "<entry>").otherwise("</feed>")
    documents = table(spark, d, "pages").select(part.alias("part"), entry.alias("e")).groupBy("part").agg(body.alias("b")).select("part", F.concat(head, F.lit("<feed>"), "b", tail).alias("feed"))
    folder = f"{work_folder(spark)}/feed"
    documents.write.partitionBy("part").text(folder)  # one document a file
    return folder


@query("a1_read_feed", f"""{FEED_PAGES} SELECT page_id AS item_id, 'page ' || page_id AS name, host || path AS url, CASE WHEN page_id % 5 = 1 THEN host || path ELSE path END AS path,
    CASE WHEN page_id % 4 = 0 THEN NULL ELSE '2024-01-0' || (1 + page_id % 9) END AS date FROM p WHERE page_id % 3 <> 0 AND part % 7 NOT IN (2, 6)""")
def a1(spark, d):
    return feeds.read_feed(spark, feed_folder(spark, d), "pages", "site.org").select("item_id", "name", "url", "path", *text("date"))


@query("a1_feed_problems", f"""{FEED_PAGES} SELECT part, CASE part % 7 WHEN 2 THEN 'dtd' WHEN 6 THEN 'malformed' END AS problem, CASE WHEN part % 7 NOT IN (2, 6) THEN count(*) END AS entries FROM p GROUP BY part""")
def a1b(spark, d):
    rows = feeds.feed_documents(spark, feed_folder(spark, d))
    return rows.select(F.regexp_extract("path", r"/part=(\d+)/", 1).cast("long").alias("part"), "problem", F.size("entries").cast("long").alias("entries"))


@query("a2_flatten_search_hits", """SELECT o_orderkey AS item_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, CASE WHEN k % 3 = 0 THEN 'p/' || k WHEN k % 3 = 1 THEN 'http://d/' || k END AS pdf_url, n AS opinions
    FROM orders JOIN (SELECT l_orderkey, arg_min(l_partkey, l_linenumber * 100000 + l_partkey) AS k, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderkey % 7 <> 0""")
def a2(spark, d):
    p = F.col("l_partkey")
    opinion = F.struct(p.alias("id"), F.when(p % 3 == 0, F.concat(F.lit("p/"), p.cast("string"))).otherwise(" ").alias("local_path"), F.when(p % 3 == 1, F.concat(F.lit("http://d/"), p.cast("string"))).otherwise("ftp://d").alias("download_url"))
    lists = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct(*line_order(), opinion.alias("o")))), lambda x: x["o"]).alias("opinions"))
    hits = table(spark, d, "orders").join(lists, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey")).alias("cluster_id"), F.lit("n").alias("caseName"), F.col("o_orderpriority").alias("court_id"), F.col("o_orderdate").cast("date").cast("string").alias("dateFiled"), F.lit(" a  b").alias("snippet"), "opinions")
    return feeds.flatten_search_hits(hits).select("item_id", *text("date"), "pdf_url", F.size("opinion_ids").cast("long").alias("opinions"))


@query("a3_flatten_master_list", "SELECT CAST(n_nationkey AS BIGINT) AS bill_id, n_name AS number FROM nation WHERE n_nationkey % 4 <> 0")
def a3(spark, d):
    n = F.col("n_nationkey")
    record = F.struct(F.when(n % 4 != 0, n).alias("bill_id"), F.col("n_name").alias("number"))
    lists = table(spark, d, "nation").groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct(n.cast("string"), record))).alias("m"))
    whole = F.to_json(F.struct(F.map_concat("m", F.create_map(F.lit("session"), F.struct(F.lit(1).alias("bill_id"), F.lit("meta").alias("number")))).alias("masterlist")))
    return feeds.flatten_master_list(lists.select(whole.alias("payload")), "payload", "bill_id LONG, number STRING")


@query("a4_read_log", "SELECT event_id, event_type, (SELECT count(*) FROM events WHERE event_id % 10 = 0) AS corrupt FROM events WHERE event_id % 10 <> 0")
def a4(spark, d):
    folder = f"{work_folder(spark)}/log"
    line = F.when(F.col("event_id") % 10 == 0, '{"event_id": ').otherwise(F.to_json(F.struct("event_id", "event_type")))
    table(spark, d, "events").select(line).write.text(folder)
    good, counts = feeds.read_log(spark, folder, "event_id LONG, event_type STRING")
    good.write.parquet(f"{folder}-good")  # the pass that counts
    return spark.read.parquet(f"{folder}-good").withColumn("corrupt", F.lit(counts.get["corrupt"]))


@query("a7_flatten_link_report", "SELECT url, CAST(404 AS INTEGER) AS status, 's' || arg_min(page_id % 5, (page_id // 500) * 5 + page_id % 5) AS source FROM pages GROUP BY url")
def a7(spark, d):
    """The report comes in parts of 500 pages, a row each."""
    link = F.array(F.struct(F.col("url"), F.lit(404).alias("status")), F.struct(F.lit("mailto:x").alias("url"), F.lit(0).alias("status")))
    rows = table(spark, d, "pages").select(F.floor(F.col("page_id") / 500).alias("part"), F.concat(F.lit("s"), (F.col("page_id") % 5).cast("string")).alias("k"), link.alias("link"))
    maps = rows.groupBy("part", "k").agg(F.flatten(F.collect_list("link")).alias("links"))
    report = maps.groupBy("part").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "links")))).alias("error_map"))
    return feeds.flatten_link_report(report, ["error_map"], "part")


@query("a10_release_dates")
def a10(spark, d):
    index = feeds.release_index(table(spark, d, "pages"), "page_id", "html")
    return feeds.as_release_dates(index, "page_id", docket_pattern=r"\b([A-Z][a-z]{7,})\b").select("docket", "page_id")


@query("t5_caption_facts", r"""SELECT doc_id, coalesce(regexp_matches(text, '\b[0-9]+ [A-Z][A-Za-z. ]{1,12} [0-9]+\b|\([0-9]{4}\)'), false) AS has_citation,
    len(list_distinct(regexp_extract_all(substr(text, 1, 3000), '\b([A-Z][0-9]{2}[A-Z][0-9]{4}|No\. [0-9-]+)\b', 1))) AS dockets FROM documents""")
def t5(spark, d):
    return T.caption_facts(table(spark, d, "documents"), "text").select("doc_id", "has_citation", F.size("caption_dockets").cast("long").alias("dockets"))


#: Word lists of the given languages in the places of the source and of what was supplied.
SOURCE, SUPPLIED = r"\b(?:bill|act|the|de|la|und|der)\b", r"\b(?:supplied|title|of|les|ein)\b"


@query("t4_silence_claims", f"""WITH r AS (SELECT doc_id, coalesce(text, '') || CASE doc_id % 4 WHEN 0 THEN ' bill does not specify fees. It is silent' WHEN 1 THEN ' the supplied act is silent' WHEN 2 THEN ' la; it fails to say' ELSE ' act; the title doesn''t clearly mention it' END AS t FROM documents),
    m AS (SELECT doc_id, regexp_extract_all(t, '(?i){values.SILENCE.replace("'", "''")}') AS m, string_split_regex(t, '(?i){values.SILENCE.replace("'", "''")}') AS p FROM r),
    k AS (SELECT doc_id, m, p, unnest(range(len(m))) AS k FROM m),
    c AS (SELECT doc_id, k, m[k + 1] AS phrase, right(array_to_string(list_transform(range(k), lambda i: p[i + 1] || m[i + 1]), '') || p[k + 1], 70) AS pre FROM k),
    f AS (SELECT doc_id, k, phrase, regexp_replace(regexp_replace(pre, '(?s)^.*;', ''), '(?s)^.*[.] ', '') AS clause FROM c)
    SELECT d.doc_id, coalesce(s, '') AS silences FROM documents d LEFT JOIN (SELECT doc_id, string_agg(phrase, '|' ORDER BY k) AS s FROM f
        WHERE regexp_matches(clause, '(?i){SOURCE}') AND NOT regexp_matches(clause, '(?i){SUPPLIED}') GROUP BY 1) USING (doc_id)""")
def t4(spark, d):
    ends = F.element_at(F.array(*map(F.lit, (" bill does not specify fees. It is silent", " the supplied act is silent", " la; it fails to say", " act; the title doesn't clearly mention it"))), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = table(spark, d, "documents").withColumn("reason", F.concat(F.coalesce("text", F.lit("")), ends))
    return T.silence_claims(rows, "reason", source=SOURCE, supplied=SUPPLIED).select("doc_id", F.array_join("silences", "|").alias("silences"))


@query("t10_stable_keys", """SELECT p_partkey, substr(sha1(lower(trim(p_type))), 1, 12) AS stable_key FROM part""")
def t10(spark, d):
    rows = table(spark, d, "part").withColumn("d", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("New "), "p_type")).otherwise(F.concat("p_type", F.lit(" (new)"))))
    return T.stable_keys(rows, "d").select("p_partkey", "stable_key")


@query("t11_issuer_label", "SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'k' ELSE o_orderpriority END AS issuer FROM orders")
def t11(spark, d):
    agencies = F.array(F.struct(F.lit("a").alias("slug"), F.col("o_orderpriority").alias("name")), F.struct(F.when(F.col("o_custkey") % 3 == 0, "k").otherwise("b").alias("slug"), F.lit("K").alias("name")))
    return T.issuer_label(table(spark, d, "orders").withColumn("agencies", agencies), "agencies", ["k"]).select("o_orderkey", "issuer")


@query("t13_assemble_items", """SELECT o_orderkey, lower(o_orderstatus) AS disposition, CASE WHEN o_orderkey % 3 = 0 THEN 'D' || o_custkey ELSE 'A' || o_orderkey END AS dockets, o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN ',x' ELSE '' END AS all_areas FROM orders""")
def t13(spark, d):
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    holdings = F.array(F.struct(F.array(F.lit("x"), F.col("o_orderpriority")).alias("areas"), F.lit("s").alias("synopsis"), F.when(k % 2 == 0, "w").otherwise(none).alias("why")))
    rows = table(spark, d, "orders").select("o_orderkey", F.array(F.lit(" "), F.when(k % 3 != 0, F.concat(F.lit("A"), k.cast("string")))).alias("dockets"), F.concat(F.lit("D"), F.col("o_custkey").cast("string")).alias("docket"), F.col("o_orderstatus").alias("disposition"), F.array("o_orderpriority").alias("areas"), holdings.alias("holdings"))
    return T.assemble_items(rows).select("o_orderkey", "disposition", F.array_join("dockets", ",").alias("dockets"), F.array_join("all_areas", ",").alias("all_areas"))


@query("t5_cited_cases")
def t5b(spark, d):
    word = F.regexp_extract("text", "([A-Za-z]{3,})", 1)
    marked = F.concat("text", F.lit(" **"), word, F.lit(" v. Roe, 12 U.S. "), F.col("doc_id").cast("string"), F.lit(" (1999)** and **only bold** and O.C.G.A. § 1-2-3"))
    return T.cited_cases(table(spark, d, "documents").withColumn("text", marked), "doc_id", "text")


@query("t5_typed_references", "WITH t AS (SELECT doc_id, text || ' O.C.G.A. §' || doc_id || '-2-3, 11 U.S.C. § ' || doc_id || ', HB ' || doc_id || ', Rule 1.7' AS t FROM documents) " + " UNION ALL ".join(
    "SELECT DISTINCT doc_id, '{0}' AS kind, '{1}' || trim(regexp_replace(r, '\\s+', ' ', 'g')) AS reference FROM (SELECT doc_id, unnest(regexp_extract_all(t, '{2}', 1)) AS r FROM t)".format(*(x.replace("'", "''") for x in (kind, *how))) for kind, how in values.REFERENCE_PATTERNS.items()))
def t5c(spark, d):
    n = F.col("doc_id").cast("string")
    cited = F.concat(F.col("text"), F.lit(" O.C.G.A. §"), n, F.lit("-2-3, 11 U.S.C. § "), n, F.lit(", HB "), n, F.lit(", Rule 1.7"))
    return T.extract_references(table(spark, d, "documents").withColumn("text", cited), "doc_id", "text")
