"""Cut lineages."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the cluster's checkpoint folder; a temporary one only on a local master without one."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="docwatch-"))
    return df.checkpoint()


def renewed(df: DataFrame) -> DataFrame:
    """As checkpointed(), and without the size that the planner guessed for df. A checkpoint keeps that guess; every join multiplies
    the guesses of its sides, so in a loop of joins they grow to numbers of megabytes in the driver. For what goes round in loops."""
    rows = checkpointed(df)
    spark = rows.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(rows._jdf.toJavaRDD(), rows._jdf.schema()), spark)
