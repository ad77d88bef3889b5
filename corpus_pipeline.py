"""Documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last keep the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docwatch.llm import mixing, packing, pii, quality, simhash
from docwatch.llm.common import checkpoint_folder, named, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.fit(docs, table(spark, sf_dir, "labels")).select(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id."""
    return simhash.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it are taken out of the texts."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long")).select(*named(docs))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy that the mixture takes of a document."""
    return mixing.mixed_documents(docs).withColumn("n_chars", F.length("text").cast("long")).select(*named(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in the packed bins."""
    return packing.pack(docs)


STAGES = [("quality_classifier", quality_classifier), ("near_dedup", near_dedup), ("personal_data", personal_data), ("source_mixture", source_mixture), ("best_fit_packing", best_fit_packing)]

#: Classifier, fingerprints and seeded draws are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result is written as Parquet to the shared folder and read again."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
