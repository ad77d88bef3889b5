"""The classifier seam: a model judges what no earlier verdict answers, and its verdicts are remembered by their inputs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwatch.operators.checkpoints import checkpointed
from docwatch.operators.state import input_fingerprint

VERDICT = "fingerprint string, passes boolean, reason string"


@dataclass(frozen=True)
class Classifier:
    """load() gives the model, a function of a frame with the input columns to a frame (passes, reason), row by row; it is called
    once per task, in the worker, before the first batch. passes is null where the model has no answer: that row comes again
    and is not remembered. version is part of what a verdict is remembered by."""

    load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]
    inputs: tuple[str, ...]
    version: str = ""
    memo: DataFrame | None = None  # (fingerprint, passes, reason)


def remembered_by(version: str, *inputs: str) -> Column:
    """The fingerprint under which a memo holds a verdict."""
    return input_fingerprint(F.lit(version).alias("version"), *inputs)


def slices(frame: pd.DataFrame, columns: list[str], most: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """The frame in stretches of rows that hold about `most` characters, so that a model's memory doesn't grow with a batch of long texts."""
    size = sum(frame[c].map(lambda v: len(v) if isinstance(v, (str, bytes)) else 8) for c in columns)
    part = size.cumsum() // most
    for _, rows in frame.groupby(part.to_numpy(), sort=False):
        yield rows.reset_index(drop=True)


def classified(rows: DataFrame, classifier: Classifier) -> tuple[DataFrame, DataFrame]:
    """Verdicts (item_id, passes, reason, remembered) on rows(item_id, the inputs), and the memo rows to add. Equal inputs are
    judged once, those in the memo not at all; verdicts are checkpointed, so that nothing that reads them calls the model again."""
    inputs = list(classifier.inputs)
    marked = rows.select("item_id", *inputs, remembered_by(classifier.version, *inputs).alias("fingerprint"))
    ids = checkpointed(marked.select("item_id", "fingerprint"))
    wanted = ids.select("fingerprint").distinct()
    old = rows.sparkSession.createDataFrame([], VERDICT)
    if classifier.memo is not None:
        old = classifier.memo.where("passes is not null").groupBy("fingerprint").agg(F.max(F.struct("passes", "reason")).alias("v")).select("fingerprint", "v.passes", "v.reason")
        wanted = wanted.join(old, "fingerprint", "left_anti")
    # one item stands for all that have its inputs, chosen before any text crosses a shuffle
    heads = checkpointed(ids.join(wanted, "fingerprint", "left_semi").groupBy("fingerprint").agg(F.min("item_id").alias("item_id")))
    load = classifier.load

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            for part in slices(frame, inputs):
                verdict = model(part[inputs])
                yield pd.DataFrame({"fingerprint": part["fingerprint"].to_numpy(), "passes": verdict["passes"].to_numpy(), "reason": verdict["reason"].to_numpy()})

    misses = marked.join(heads, ["item_id", "fingerprint"], "left_semi").dropDuplicates(["fingerprint"])
    new = checkpointed(misses.mapInPandas(judge, VERDICT)).where("passes is not null")
    known = old.withColumn("remembered", F.lit(True)).union(new.withColumn("remembered", F.lit(False)))
    return checkpointed(ids.join(known, "fingerprint").select("item_id", "passes", "reason", "remembered")), new
