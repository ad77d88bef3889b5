import duckdb
import pytest

from docwatch.llm import queries


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - {"pipeline"}))
def test_query_over_the_given_tables(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    got = df.collect()
    assert got
    if name in queries.ORACLES:
        con = duckdb.connect()
        for t in ("documents", "pages", "embeddings", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        cur = con.execute(queries.ORACLES[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted((tuple(plain(r[c]) for c in names) for r in got), key=str) == sorted((tuple(map(plain, r)) for r in cur.fetchall()), key=str)


def test_op5_keeps_the_law_and_op2_the_components(spark, sf):
    rows = queries.op5_sharding(spark, sf).collect()
    counts = [sum(r.shard == s for r in rows) for s in range(16)]
    assert max(counts) - min(counts) <= 1 and {r.law for r in rows} == {"rows"}
    parts = {}
    for r in queries.op2_simhash_near_dedup(spark, sf).collect():
        parts.setdefault(r.component_id, []).append(r.doc_id)
    assert all(min(v) == k for k, v in parts.items())
