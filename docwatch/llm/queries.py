"""The operators as queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docwatch.llm import merkle, mixing, packing, pii, quality, queries_turns, sharding, simhash, substring, topk, urlfilter
from docwatch.llm.common import table

#: (verdict, host, path): fixed values.
HOST_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Listing pages, tracked links, sessions, logins, shops and ad servers; articles about ads are let through.
URL_PATTERNS = [
    "^page=", "^ref=", "^utm_source=", "^sessionid=", "^sid=*&", "/login^", "/signup^", "/wp-login.php", "/cart^", "/checkout/*",
    "||ads.", "||tracker.", "/ads/*", "/tag/", "^sort=*^page=", "@@/articles/ads/*",
]


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(F.array(*map(F.lit, pii.KINDS)), s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, _ = pii.mark(table(spark, sf_dir, "documents"))
    terms = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), F.lit(4).alias("kind"), t["end"].alias("end")))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return rows.select("doc_id", n(0).alias("n_email"), n(1).alias("n_ip"), n(2).alias("n_card"), n(3).alias("n_phone"),
                       F.sha2(joined("base"), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", terms))).alias("spans"), F.size("terms").cast("long").alias("n_terms"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), HOST_RULES, URL_PATTERNS).select("page_id", "host", "path", "rule", "verdict")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shards")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shuffle_into_shards(table(spark, sf_dir, "documents"), shards=16)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return rows.select("doc_id", "size", crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5, scale=256)


def op7_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merkle.edited(table(spark, sf_dir, "documents"))
    three = ("text", "edited", "next_text")
    trees = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), *(merkle.tree(F.col(c)).alias(f"{c}_tree") for c in three))
    leaves = trees.select("*", *(merkle.leaf_set(F.col(f"{c}_tree")).alias(f"{c}_leaves") for c in three), *(merkle.root(F.col(f"{c}_tree")).alias(f"{c}_root") for c in three))
    near = lambda c: merkle.likeness(*(F.col(f"{x}_{part}") for part in ("tree", "leaves") for x in ("text", c)), F.col("text_root") == F.col(f"{c}_root"))
    return leaves.select("doc_id", "n_chars", "edited_sha256", merkle.fingerprint(F.col("text_tree")).alias("fingerprint"), merkle.fingerprint(F.col("edited_tree")).alias("edited_fingerprint"),
                         near("edited").alias("near_edited"), near("next_text").alias("near_next"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring.remove_repeats(table(spark, sf_dir, "documents"), window=20)
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.fit(docs, table(spark, sf_dir, "labels")).fitted()


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_pii_disclosure, op2_simhash_near_dedup, op3_url_filters, op4_mixing, op5_sharding, op6_exact_top_k, op7_merkle_fingerprints, op8_substring_dedup, op9_best_fit_packing, op10_quality_classifier, pipeline)} | queries_turns.QUERIES

ORACLES = {
    "op7_merkle_fingerprints": r"""
        WITH n AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS c, coalesce(lead(coalesce(text, '')) OVER o, first_value(coalesce(text, '')) OVER o) AS nx FROM documents WINDOW o AS (ORDER BY doc_id)),
        e AS (SELECT doc_id, t, c, substr(t, 1, c - c // 2) || substr(nx, 1, c // 2) AS ed FROM n),
        x AS (SELECT doc_id, 0 AS w, t AS s FROM e UNION ALL SELECT doc_id, 1, ed FROM e),
        y AS (SELECT doc_id, w, list_filter(string_split(replace(s, chr(10), chr(10) || chr(31)), chr(31)), lambda z: z <> '') AS ls FROM x),
        l AS (SELECT doc_id, w, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM y),
        m AS (SELECT *, coalesce(sum(CASE WHEN line = chr(10) AND i > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, w ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sec FROM l),
        a AS (SELECT doc_id, w, sec, i, list_filter(string_split(regexp_replace(line, '([.!?] )', '\1' || chr(31), 'g'), chr(31)), lambda z: z <> '') AS ps FROM m),
        p AS (SELECT doc_id, w, sec, i, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS j FROM a),
        b AS (SELECT doc_id, w, sec, i, j, CASE WHEN length(p) > 200 THEN regexp_extract_all(p, '(?s).{1,100}') ELSE [p] END AS qs FROM p),
        q AS (SELECT doc_id, w, sec, i, j, unnest(qs) AS q, unnest(range(1, len(qs) + 1)) AS k FROM b),
        h AS (SELECT doc_id, w, sec, list(sha256(q) ORDER BY i, j, k) AS hs FROM q GROUP BY 1, 2, 3),
        r AS (SELECT *, sha256(array_to_string(hs, '')) AS sh FROM h),
        g AS (SELECT doc_id, w, sha256(string_agg(sh, '' ORDER BY sec)) || ':' || string_agg(substr(sh, 1, 12) || '(' || array_to_string(list_transform(hs, lambda z: substr(z, 1, 12)), ',') || ')', '' ORDER BY sec) AS fp,
              list_distinct(flatten(list(hs))) AS leaves FROM r GROUP BY 1, 2),
        f AS (SELECT doc_id, w, coalesce(fp, sha256(sha256(sha256(''))) || ':' || substr(sha256(sha256('')), 1, 12) || '(' || substr(sha256(''), 1, 12) || ')') AS fp, coalesce(leaves, [sha256('')]) AS leaves FROM x LEFT JOIN g USING (doc_id, w)),
        o AS (SELECT doc_id, fp, leaves, coalesce(lead(leaves) OVER o, first_value(leaves) OVER o) AS nl FROM f WHERE w = 0 WINDOW o AS (ORDER BY doc_id))
        SELECT e.doc_id, c AS n_chars, sha256(ed) AS edited_sha256, o.fp AS fingerprint, v.fp AS edited_fingerprint,
            2.0::DOUBLE * len(list_intersect(o.leaves, v.leaves)) / (len(o.leaves) + len(v.leaves)) AS near_edited, 2.0::DOUBLE * len(list_intersect(o.leaves, nl)) / (len(o.leaves) + len(nl)) AS near_next
        FROM e JOIN o USING (doc_id) JOIN f v ON v.doc_id = e.doc_id AND v.w = 1""",
    "op8_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20),
        k AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS seq FROM s),
        f AS (SELECT doc_id, i, min(doc_id * 10000000 + i) OVER (PARTITION BY seq) < doc_id * 10000000 + i AS later FROM k),
        g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM f WHERE later),
        w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d WHERE len(ws) > 0),
        t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM w ANTI JOIN g USING (doc_id, i) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN t USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM g GROUP BY 1) USING (doc_id)""",
    "op3_url_filters": r"""
        WITH u AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
        h AS (SELECT page_id, url, rest, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw FROM u),
        p AS (SELECT page_id, url, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM h),
        r AS (SELECT *, CASE
            WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
            WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
            WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
            WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
        SELECT page_id, host, path, rule, CASE
            WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL OR host = '' THEN 'allow'
            WHEN regexp_matches(lower(url), '/articles/ads/') THEN 'allow'
            WHEN regexp_matches(lower(url), '[^a-z0-9_.%-](page|ref|utm_source|sessionid)=|[^a-z0-9_.%-]sid=.*&|/(login|signup|cart)([^a-z0-9_.%-]|$)|/wp-login[.]php|/checkout/|://([^/?#]*[.])?(ads|tracker)[.]|/ads/|/tag/') THEN 'block'
            ELSE 'allow' END AS verdict FROM r""",
    "op6_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
        k AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r, vec_id, score FROM s)
        SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM k WHERE r <= 5""",
} | queries_turns.ORACLES
