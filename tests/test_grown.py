"""Queries against their SQL on rows that the given small tables don't have."""

import datetime

import duckdb
import pytest

import __spark_entry__

DAY = datetime.datetime(1996, 3, 13)


@pytest.fixture
def same(spark, tmp_path):
    """same(query, **tables): the query's rows and its SQL's on tables of (rows, schema) are one and the same."""

    def check(name, **tables):
        con = duckdb.connect()
        for t, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{t}.parquet")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        df = __spark_entry__.queries()[name](spark, str(tmp_path))
        cur = con.execute(__spark_entry__.oracle_sql()[name])
        columns = [c[0] for c in cur.description]
        assert sorted(map(str, df.select(*columns).collect())) == sorted(str(df.sparkSession.createDataFrame([r], df.select(*columns).schema).first()) for r in cur.fetchall())

    return check


def lines(rows):
    return [(o, p, n, "O") for o, n, p in rows], "l_orderkey long, l_partkey long, l_linenumber int, l_linestatus string"


def orders(keys):
    return [(k, k, "O", 1.5 * k, DAY, "1-URGENT") for k in keys], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"


LINES = [(1, 1, 119_999), (1, 2, 3), (2, 1, 5), (2, 2, 9), (3, 3, 250_002), (3, 4, 120_003), (3, 5, 6)]


def test_search_hits_of_high_parts(same):
    same("a2_flatten_search_hits", lineitem=lines(LINES), orders=orders([1, 2, 3]))


#: Lines of one number; tied rows are neighbours in one file, so that any number of DuckDB's threads meets them in this order.
TIES = [(1, 2, 5), (1, 1, 100_005), (2, 1, 100_007), (2, 2, 7), (3, 4, 3), (3, 1, 300_003), (4, 1, 300_009), (4, 4, 9)]


def test_search_hits_of_lines_of_one_number(same):
    same("a2_flatten_search_hits", lineitem=lines(TIES), orders=orders([1, 2, 3, 4]))


def test_enrich_with_high_parts(same):
    same("d17_enrich", lineitem=lines(LINES), orders=orders([1, 2, 3]))


def test_enrich_with_lines_of_one_number(same):
    same("d17_enrich", lineitem=lines(TIES), orders=orders([1, 2, 3, 4]))


def test_official_link_of_high_parts(same):
    same("d7_official_link", lineitem=lines(LINES), part=([(p,) for _, _, p in LINES], "p_partkey long"))


def test_official_link_of_lines_of_one_number(same):
    same("d7_official_link", lineitem=lines(TIES), part=([(p,) for _, _, p in TIES], "p_partkey long"))


def test_silence_next_to_other_letters(same):
    texts = ["éact", "éles", "ofé", "Büla", "é of", "the écode", None]
    same("t4_silence_claims", documents=([(k, t) for k, t in enumerate(texts * 4)], "doc_id long, text string"))


def test_citations_next_to_other_letters(same):
    rows = [(k, t) for k, t in enumerate(["é12 Foo 3", "12 Foo 3é", "12 Foo 3x", "éA12B3456", None])]
    same("t5_caption_facts", documents=(rows, "doc_id long, text string"))


def test_merge_counts_from_a_million_on(same):
    same("g1_merge_counts", orders=orders([21, 1_000_021, 1_000_006, 1_000_013, 42, 999_999, 999_992]))


PAGES = [(k, f"http://x/{k // 5 if k < 30 else k}", f"<p>{'The ' if k % 4 else ''}{k}</p>") for k in range(60)], "page_id long, url string, html string"


def test_page_changes_of_one_url(same):
    same("g5_detect_page_changes", pages=PAGES)


def test_page_state_of_one_url(same):
    same("g5_page_state", pages=PAGES)
