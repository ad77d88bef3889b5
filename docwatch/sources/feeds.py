"""Sources and sinks: feeds, nested payloads, logs, pages, slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from docwatch.functions.text import blank_to_null
from docwatch.operators.select import positions

FEED = """entry array<struct<title string, published string, updated string, summary string,
link array<struct<_href:string,_rel:string,_type:string>>>>, _corrupt string"""


def feed_documents(spark: SparkSession, path: str, max_bytes: int = 64 * 2**20) -> DataFrame:
    """A1: (path, length, problem, entries) of the feed files under a path. A file is a document and is parsed whole, so one over max_bytes
    isn't read but reported (`size`), like one that declares a DTD or an entity (`dtd`; sought with NULs taken out, so that no
    wide encoding hides it), one that isn't UTF-8 (`encoding`) and one that doesn't parse (`malformed`); the others have null. Spark passes over files of no bytes:
    they have no row."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    small = files.where(F.col("length") <= max_bytes)  # reaches the source, which then skips the content
    probe = F.translate(F.decode("content", "ISO-8859-1"), "\0", "")
    guard = F.when(probe.contains("<!DOCTYPE") | probe.contains("<!ENTITY"), "dtd").when(~F.is_valid_utf8(F.col("content").cast("string")), "encoding")
    guarded = small.withColumn("problem", guard)
    body = F.when(F.col("problem").isNull(), F.regexp_replace(F.col("content").cast("string"), "^\ufeff", ""))
    parsed = guarded.withColumn("feed", F.from_xml(body, FEED, {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("problem").isNull() & (F.col("feed").isNull() | F.col("feed._corrupt").isNotNull())
    read = parsed.select("path", "length", F.when(bad, "malformed").otherwise(F.col("problem")).alias("problem"), F.when(~bad, F.col("feed.entry")).alias("entries"))
    large = files.where(F.col("length") > max_bytes).select("path", "length", F.lit("size").alias("problem"), F.lit(None).cast(read.schema["entries"].dataType).alias("entries"))
    return read.unionByName(large)


def read_feed(spark: SparkSession, path: str, source: str, host: str | None = None, max_bytes: int = 64 * 2**20) -> DataFrame:
    """A1: Atom entries of the documents without a problem (feed_documents) as candidates; entries without an id are skipped. path is the
    site's own part of the url where the link is on `host` or a name under it; a link elsewhere, also on a look-alike, keeps
    its whole url there. The alternate link is the last that names an opinion."""
    raw = feed_documents(spark, path, max_bytes).where("problem is null").select(F.explode("entries").alias("e")).select("e.*")
    last = lambda test: F.try_element_at(F.filter("link", test), F.lit(-1))["_href"]
    page = last(lambda x: (x["_rel"] == "alternate") & x["_href"].contains("/opinion/"))
    pdf = last(lambda x: (x["_rel"] == "enclosure") & ((x["_type"] == "application/pdf") | x["_href"].endswith(".pdf")))
    named = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    own = F.lit(False) if host is None else (named == host) | named.endswith(f".{host}")
    local = F.regexp_replace("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", "")
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("summary", F.lit("")), r"(?s)<[^>]*>", " "), r"\s+", " "))
    rows = raw.withColumn("url", page)
    return rows.select(
        F.regexp_extract("url", r"/opinion/(\d+)/", 1).try_cast("bigint").alias("item_id"),
        F.trim("title").alias("name"),
        F.lit(source).alias("source"),
        "url",
        F.when(own, F.when(local.startswith("/"), local).otherwise(F.concat(F.lit("/"), local))).otherwise(F.col("url")).alias("path"),
        pdf.alias("pdf_url"),
        F.try_to_date(F.substring(F.coalesce(blank_to_null(F.col("published")), "updated"), 1, 10), "yyyy-MM-dd").alias("date"),
        F.substring(plain, 1, 1500).alias("snippet"),
        blank_to_null(F.regexp_extract(plain, r"(?i)docket (?:no\.?|number)[: ]*([A-Z0-9-]+)", 1)).alias("docket"),
    ).where("item_id is not null")


def flatten_search_hits(df: DataFrame) -> DataFrame:
    """A2: hits(cluster_id, caseName, court_id, dateFiled, snippet, opinions ARRAY<STRUCT<id, local_path, download_url>>) to candidates."""
    first = F.get("opinions", F.lit(0))
    pdf = F.coalesce(blank_to_null(first["local_path"]), F.when(first["download_url"].rlike("^https?://"), first["download_url"]))
    return df.where("cluster_id is not null").select(
        F.col("cluster_id").alias("item_id"), F.col("caseName").alias("name"), F.col("court_id").alias("source"), F.try_to_date("dateFiled", "yyyy-MM-dd").alias("date"),
        F.trim(F.regexp_replace(F.coalesce("snippet", F.lit("")), r"\s+", " ")).alias("snippet"), pdf.alias("pdf_url"), F.transform(F.coalesce("opinions", F.array().cast(df.schema["opinions"].dataType)), lambda o: o["id"]).alias("opinion_ids"),
    )


def flatten_master_list(df: DataFrame, payload: str, record: str, metadata_key: str = "session", id_field: str = "bill_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """A3: a JSON map of records under `masterlist` with one metadata entry, to a row per record that has an id, with the
    columns `keep` of its list. record is the struct's DDL."""
    parsed = F.from_json(payload, f"masterlist MAP<STRING, STRUCT<{record}>>")["masterlist"]
    return df.select(*keep, F.explode(parsed).alias("k", "r")).where(F.col("k") != metadata_key).select(*keep, "r.*").where(F.col(id_field).isNotNull())


def read_log(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, Observation]:
    """A4: the good rows of a JSONL log, and the counts of lines, good and corrupt ones as metrics of the pass that reads it: after the first
    action on the rows, get holds them; the log isn't read a second time. Blank lines count as neither."""
    lines = spark.read.text(path).where(blank_to_null(F.col("value")).isNotNull())
    parsed = lines.select(F.from_json("value", f"{schema}, _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}).alias("r"))
    ok = F.expr("r is not null and r._corrupt is null")
    counts = Observation()
    seen = parsed.observe(counts, F.count(F.lit(1)).alias("lines"), F.count_if(ok).alias("good"), F.count_if(~ok).alias("corrupt"))
    return seen.where(ok).select("r.*").drop("_corrupt"), counts


def flatten_link_report(df: DataFrame, maps: list[str], part: str | None = None) -> DataFrame:
    """Crawler maps url -> ARRAY<STRUCT<url, status>> by source under any of several columns, to distinct failing http(s) links; the first source stays.
    A large report comes in parts, a row each, in the order of the column `part`."""
    at = F.col(part) if part else F.lit(0)
    parts = [df.select(at.alias("part"), F.posexplode(F.map_entries(F.coalesce(m, F.create_map().cast(df.schema[m].dataType)))).alias("pos", "e"), F.lit(k).alias("m")) for k, m in enumerate(maps)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    flat = rows.select("part", "m", "pos", F.col("e.key").alias("source"), F.posexplode("e.value").alias("at", "link")).select("part", "m", "pos", "at", "source", F.trim("link.url").alias("url"), "link.status")
    first = Window.partitionBy("url").orderBy("part", "m", "pos", "at", "source")
    return flat.where(F.col("url").rlike("^https?://")).withColumn("n", F.row_number().over(first)).where("n = 1").select("url", "status", "source")


def release_index(df: DataFrame, page: str, html: str, pattern: str = r"(?is)<(h[1-6]|li)\b[^>]*>(.*?)</\1>") -> DataFrame:
    """A10: list items of a listing page with the nearest heading above them: (page, pos, heading, item). as_release_dates picks the newest per docket."""
    found = F.regexp_extract_all(html, F.lit(pattern), 0)
    rows = df.select(page, F.posexplode(found).alias("pos", "raw")).withColumn("is_heading", F.lower("raw").rlike("^<h[1-6]"))
    plain = F.trim(F.regexp_replace(F.regexp_replace("raw", r"(?s)<[^>]*>", " "), r"\s+", " "))
    above = F.last(F.when(F.col("is_heading"), F.col("plain")), ignorenulls=True).over(Window.partitionBy(page).orderBy("pos"))
    return rows.withColumn("plain", plain).withColumn("heading", above).where("not is_heading").select(page, "pos", "heading", F.col("plain").alias("item"))


def as_release_dates(index: DataFrame, page: str, docket_pattern: str = r"\b([A-Z][0-9]{2}[A-Z][0-9]{4})\b", date_format: str = "MMMM d, yyyy") -> DataFrame:
    """A10: one row (docket, released, page) per docket of an index; the newest release wins, a docket listed twice counts once."""
    dated = index.withColumn("released", F.try_to_date(F.regexp_extract("heading", r"([A-Z][a-z]+ [0-9]{1,2}, [0-9]{4})", 1), date_format))
    rows = dated.select(F.explode(F.array_distinct(F.regexp_extract_all("item", F.lit(docket_pattern), 1))).alias("docket"), "released", page, "pos")
    newest = Window.partitionBy("docket").orderBy(F.col("released").desc_nulls_last(), page, "pos")
    return rows.withColumn("n", F.row_number().over(newest)).where("n = 1").select("docket", "released", page)


def extract_links(df: DataFrame, page: str, html: str, skip: tuple[str, ...] = ("#", "mailto:", "javascript:", "data:")) -> DataFrame:
    """Distinct (page, href) without the skip list."""
    href = F.explode(F.array_distinct(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), 1)))
    rows = df.select(page, href.alias("href")).where(F.col("href") != "")
    for prefix in skip:
        rows = rows.where(~F.lower("href").startswith(prefix))
    return rows


def slices(df: DataFrame, areas: str, known: DataFrame, order: list) -> tuple[DataFrame, DataFrame]:
    """(rows per area, newest first within `position`; the index area, n with untouched areas of known(area) as 0)."""
    rows = df.withColumn("area", F.explode(areas))
    counts = known.join(rows.groupBy("area").agg(F.count("*").alias("n")), "area", "left").select("area", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return positions(rows, ["area"], order), counts


def write_slices(sliced: DataFrame, path: str, index: DataFrame | None = None, index_path: str | None = None) -> None:
    """A folder per area, written by ranges of positions, so that many tasks share a large area; and the index, one file."""
    sliced.repartitionByRange("area", "position").sortWithinPartitions("area", "position").write.partitionBy("area").mode("overwrite").parquet(path)
    if index is not None:
        index.orderBy("area").coalesce(1).write.mode("overwrite").parquet(index_path)  # a row per area


def append_bounded(log: DataFrame, new: DataFrame, sequence: str, cap: int) -> DataFrame:
    """Log and new rows, of which the cap highest sequence numbers stay. The threshold is one row; no global sort of the log is kept."""
    both = log.unionByName(new)
    last = both.select(F.col(sequence).alias("__s")).orderBy(F.desc("__s")).limit(cap).agg(F.min("__s").alias("__least"))
    return both.join(F.broadcast(last), both[sequence] >= last["__least"]).drop("__least")  # last is one row
