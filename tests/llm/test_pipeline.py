import corpus_pipeline
from docwatch.llm import queries


def test_stages_take_effect_and_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    n = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == names, name
        n.append(docs.count())
        if name != "source_mixture":
            assert docs.select("doc_id").distinct().count() == n[-1]
    assert n[0] > n[1] > n[2] == n[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.agg({"n_words": "sum"}).first()[0] == sum(len((r.text or "").encode().split()) for r in docs.collect())


def test_run_gives_the_last_stage(spark, sf):
    assert queries.pipeline(spark, sf).count() > 0


def test_stages_on_edge_cases(spark, docs, none, sf):
    """Null ids and texts, empty and very long texts, repeated rows, clashing columns; and no rows at all."""
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, sf).cache()
        assert rows.columns == docs.columns, name
        assert rows.count() > 0, name
        assert rows.where("doc_id is null").count() <= 2, name
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, sf)
    assert packed.agg({"n_words": "sum"}).first()[0] == sum(len((r.text or "").encode().split()) for r in rows.collect())
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0, name


def test_sanitised_texts_hold_no_base_span(spark, sf):
    from docwatch.llm import pii

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert any(pii.base_spans(r.text) for r in docs.collect())
    out = corpus_pipeline.personal_data(spark, docs, sf).collect()
    assert len(out) == docs.count() and all(r.n_chars == len(r.text) for r in out)
    assert not any(pii.base_spans(r.text) for r in out)
