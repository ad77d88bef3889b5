"""Structured Streaming forms of the continuous jobs. Each has a batch twin; drain() runs one to the end of its input."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from docwatch.operators.checkpoints import checkpointed
from docwatch.operators.state import detect_page_changes
from docwatch.streaming.parts import PartedTable


def file_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet file, or folder of files, `name` as a stream source."""
    path = f"{folder}/{name}.parquet"
    batch = spark.read.parquet(path)
    reader = spark.readStream.schema(batch.schema)
    if any(f.endswith(f"/{name}.parquet") for f in batch.inputFiles()):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return reader.parquet(path)


def work_folder(spark: SparkSession) -> str:
    """A new folder in the cluster's shared checkpoint folder."""
    checkpointed(spark.range(1))  # sets the folder where none is set
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def drain(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Runs a stream over all input that is there, into Parquet, and reads the result. With the folder of an earlier call
    it goes on where that one ended."""
    spark = stream.sparkSession
    folder = folder or work_folder(spark)
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def stream_batches(stream: DataFrame, step: Callable[[DataFrame, DataFrame | None], DataFrame], folder: str | None = None, key: str = "item_id", parts: int = 256) -> DataFrame:
    """Every micro-batch through step(batch, known), whose results have the column `key`; known holds the keys of earlier
    results as far as they share a hash part with the batch (None before the first result). A batch's results are written under
    its id, so a replay replaces them; keys lie in a PartedTable, of which a batch reads and writes only the parts its own keys fall
    into, not the results of all batches before. A call with the folder of an earlier one goes on where that one ended."""
    spark = stream.sparkSession
    folder = folder or work_folder(spark)
    kind = stream.schema[key].dataType.simpleString()

    def run(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        keys = PartedTable(s, f"{folder}/keys", key, f"{key} {kind}", parts)
        batch = batch.persist()  # the source is read once
        touched = keys.touched(batch)
        held = keys.paths(batch_id, touched)
        known = keys.read(batch_id, touched)
        step(batch, known if held else None).write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")
        new = s.read.parquet(f"{folder}/out/batch={batch_id}").select(F.col(key).cast(kind).alias(key))
        keys.write(batch_id, touched, known.union(new).distinct())
        batch.unpersist()

    q = stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch")


def stream_dedup(stream: DataFrame, key: str, ts: str, delay: str, seen: DataFrame) -> DataFrame:
    """First row per key within the watermark's delay; ids known for longer are a static table."""
    return stream.withWatermark(ts, delay).join(seen, key, "left_anti").dropDuplicatesWithinWatermark([key])


def micros(interval: str) -> int:
    """An interval such as "1 hour" in microseconds."""
    return pd.Timedelta(interval) // pd.Timedelta("1us")


PANES = pa.schema([("who", pa.string()), ("pane", pa.int64()), ("n", pa.int64())])
NO_PANES = PANES.empty_table().to_pandas()
MERGE = 100_000  # rows that wait for a merge at most, or as many as there are merged ones


def summed(rows: pd.DataFrame) -> pd.DataFrame:
    """One row per account and pane, in this order, with the sum of n."""
    return rows.groupby(["who", "pane"], dropna=False, as_index=False)["n"].sum()


def packed(rows: pd.DataFrame) -> bytes:
    """An Arrow stream of the rows, which fits in a state."""
    table = pa.Table.from_pandas(rows, PANES, preserve_index=False)
    with pa.BufferOutputStream() as out:
        with pa.ipc.new_stream(out, PANES) as writer:
            writer.write_table(table)
        return out.getvalue().to_pybytes()


def stream_usage(stream: DataFrame, account: str, ts: str, span: str = "1 hour", slide: str = "1 minute", delay: str = "1 hour", parts: int = 1024) -> DataFrame:
    """S3: calls per account in sliding windows, in runs: (account, first, last, calls) are the windows that start at first, a slide
    later, and so on up to last (microseconds), and hold equally many calls; usage_windows() opens them. A window comes out once the
    watermark has passed its end; a call is late once the watermark has passed its pane, which is as long as the slide. The delay
    counts in whole slides, rounded up. Rows without a time are left out.

    A count changes only where a pane comes in or goes out of the span, so the state is the counts of the panes whose windows are not
    over, and an event costs at most two runs, whatever number of windows hold it. Accounts share the state of a hash part, and
    a step takes a part at once. Before the shuffle each task counts the calls of a pane, so a busy pane is few rows."""
    step_us, size = micros(slide), micros(span) // micros(slide)
    if step_us % 1000 or micros(span) % step_us:
        raise ValueError(f"the span ({span}) must be a multiple of the slide ({slide}), and that one of a millisecond")

    def per_pane(batches):
        for b in batches:
            rows = pa.Table.from_batches([b]).group_by(["part", "who", "pane"]).aggregate([([], "count_all")])
            yield from rows.rename_columns(["part", "who", "pane", "n"]).to_batches()

    def step(key, frames, state):
        done, rows = None, NO_PANES
        if state.exists:
            done, kept = state.get
            rows = pa.ipc.open_stream(bytes(kept)).read_all().to_pandas()
        if not state.hasTimedOut:
            new, waiting = [], 0
            for f in frames:
                new.append(f[["who", "pane", "n"]])
                waiting += len(f)
                if waiting > max(MERGE, len(rows)):
                    rows, new, waiting = summed(pd.concat([rows, *new])), [], 0
            rows = summed(pd.concat([rows, *new]))
        live_from = state.getCurrentWatermarkMs() * 1000 // step_us - size + 1  # the windows before this one are over
        moves = summed(pd.concat([rows.assign(pane=rows["pane"] - size + 1), rows.assign(pane=rows["pane"] + 1, n=-rows["n"])]))
        stop, calls = moves["pane"].shift(-1, fill_value=live_from).clip(upper=live_from), moves["n"].cumsum()  # 0 after an account's last move
        first = moves["pane"] if done is None else moves["pane"].clip(lower=done)
        runs = pd.DataFrame({"who": moves["who"], "first": first * step_us, "last": (stop - 1) * step_us, "calls": calls})[(first < stop) & (calls > 0)]
        live = rows[rows["pane"] >= live_from]
        if len(live):
            state.update((int(live_from), packed(live)))
            state.setTimeoutTimestamp((max(live_from, int(live["pane"].min()) - size + 1) + size) * step_us // 1000 - 1)  # a timeout comes after its time
        elif state.exists:
            state.remove()
        if len(runs):
            yield runs

    calls = stream.where(F.col(ts).isNotNull()).select(F.pmod(F.hash(account), F.lit(parts)).alias("part"), F.col(account).cast("string").alias("who"), F.unix_micros(ts).alias("us"))
    calls = calls.selectExpr("part", "who", f"(us - pmod(us, {step_us})) div {step_us} as pane")
    panes = calls.mapInArrow(per_pane, "part int, who string, pane long, n long").withColumn("until", F.timestamp_micros((F.col("pane") + 1) * step_us - 1))
    # Whole slides before a pane's last microsecond lies in the same pane as whole slides before any of its calls: the same panes and windows are over.
    watched = panes.withWatermark("until", f"{-(-micros(delay) // step_us) * step_us // 1000} milliseconds").groupBy("part")
    runs = watched.applyInPandasWithState(step, "who string, first long, last long, calls long", "done long, panes binary", "append", GroupStateTimeout.EventTimeTimeout)
    return runs.select(F.col("who").cast(stream.schema[account].dataType).alias(account), "first", "last", "calls")


def usage_windows(runs: DataFrame, account: str, span: str = "1 hour", slide: str = "1 minute") -> DataFrame:
    """The runs of stream_usage(), a stream or what it has left, as windows: start, end, account, calls."""
    at = F.explode(F.sequence("first", "last", F.lit(micros(slide)))).alias("at")
    return runs.select(at, account, "calls").select(F.timestamp_micros("at").alias("start"), F.timestamp_micros(F.col("at") + micros(span)).alias("end"), account, "calls")


def stream_digest(stream: DataFrame, kind: str, ts: str, delay: str = "7 days") -> DataFrame:
    """Counts per kind in weeks that start on Mondays (the epoch was a Thursday)."""
    per = stream.withWatermark(ts, delay).groupBy(F.window(ts, "7 days", "7 days", "4 days"), kind).agg(F.count("*").alias("n"))
    return per.select(F.to_date("window.start").alias("week"), kind, "n")


FAR = 2**62
CHECKS = {"min_f": "min", "max_f": "max", "min_h": "min", "max_h": "max", "n_f": "sum"}  # how two summaries of a second become one


def stream_two_strike(stream: DataFrame, wait_seconds: int = 86_400, delay: str = "1 day") -> DataFrame:
    """(url, failed, ts) checks: the first failure makes a suspect with a clock, a healthy check clears it, a failure
    after the wait (at least a second) confirms it. Rows of a batch are taken in time order, at equal times healthy ones first; a suspect
    nobody checks again leaves after 30 days. Rows without a time are left out, an unknown outcome is healthy.

    Before the shuffle each task sums a url's checks up in a row per second: first and last failure, first and last healthy
    check, and whether there are two failures. Nothing else of a second can change the outcome, and such rows add up,
    so a url that is checked all the time costs a row per second, whatever number of checks there are."""

    def per_second(frames):
        for f in frames:
            at, bad = f["us"], f["failed"].astype(bool)
            one = pd.DataFrame({"url": f["url"], "second": at // 1_000_000, "min_f": at.where(bad, FAR), "max_f": at.where(bad, -FAR), "min_h": at.where(~bad, FAR), "max_h": at.where(~bad, -FAR), "n_f": bad.astype("int64")})
            out = one.groupby(["url", "second"], dropna=False, sort=False, as_index=False).agg(CHECKS)
            yield out.assign(n_f=out["n_f"].clip(upper=2), last=out[["max_f", "max_h"]].max(axis=1))

    def step(key, frames, state):
        first = state.get[0] if state.exists else None
        out = []
        if state.hasTimedOut:
            state.remove()
            return
        seconds: dict[int, tuple] = {}
        for f in frames:
            for now, *s in zip(f["second"], *(f[c] for c in CHECKS)):
                o = seconds.get(now, (FAR, -FAR, FAR, -FAR, 0))
                seconds[now] = (min(o[0], s[0]), max(o[1], s[1]), min(o[2], s[2]), max(o[3], s[3]), o[4] + s[4])
        for now, (min_f, max_f, min_h, max_h, n_f) in sorted(seconds.items()):
            healthy = min_h < FAR
            checks = [True] * min(n_f, 2) if not healthy else [True] * (min_f < min_h) + [False] + [True] * (n_f > 0 and max_f >= max_h)
            for failed in checks:
                if not failed:
                    first = None
                elif first is None:
                    first = now
                elif now - first >= wait_seconds:
                    out.append((key[0], first, now))
                    first = None
        if first is None:
            if state.exists:
                state.remove()
        else:
            state.update((int(first),))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (int(first) + 30 * 86_400) * 1000))
        yield pd.DataFrame(out, columns=["url", "first_failed", "confirmed_at"])

    checks = stream.where("ts is not null").select("url", F.coalesce("failed", F.lit(False)).alias("failed"), F.unix_micros("ts").alias("us"))
    seconds = checks.mapInPandas(per_second, f"url string, second long, {', '.join(f'{c} long' for c in CHECKS)}, last long")
    watched = seconds.withColumn("ts", F.timestamp_micros("last")).withWatermark("ts", delay).groupBy("url")
    return watched.applyInPandasWithState(step, "url string, first_failed long, confirmed_at long", "first long", "append", GroupStateTimeout.EventTimeTimeout)


def stream_staleness(stream: DataFrame, hours: int, delay: str = "1 hour") -> DataFrame:
    """(source, last_seen) for every gap of more than `hours` between a source's rows, also a gap that is still open when the watermark passes.
    Rows without a time are left out.

    Inside a slot of `hours` there is no such gap, so before the shuffle each task sums a source's rows up in the first and last
    of each slot; a busy source costs a row per slot and task, and its state step holds two numbers per slot."""
    limit = hours * 3600

    def per_slot(frames):
        for f in frames:
            one = pd.DataFrame({"source": f["source"], "slot": f["s"] // limit, "first": f["s"], "last": f["s"]})
            yield one.groupby(["source", "slot"], dropna=False, sort=False, as_index=False).agg({"first": "min", "last": "max"})

    def step(key, frames, state):
        last = state.get[0] if state.exists else None
        out = []
        if state.hasTimedOut:
            out.append((key[0], last, True))
            state.remove()
        else:
            slots: dict[int, tuple] = {}
            for f in frames:
                for slot, low, high in zip(f["slot"], f["first"], f["last"]):
                    o = slots.get(slot, (low, high))
                    slots[slot] = (min(o[0], low), max(o[1], high))
            for _, (low, high) in sorted(slots.items()):
                if last is not None and low - last > limit:
                    out.append((key[0], last, False))
                last = max(high, last) if last is not None else high
            state.update((int(last),))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (int(last) + limit) * 1000))
        yield pd.DataFrame(out, columns=["source", "last_seen", "open"])

    slots = stream.where("ts is not null").select("source", F.unix_seconds("ts").alias("s")).mapInPandas(per_slot, "source string, slot long, first long, last long")
    watched = slots.withColumn("ts", F.timestamp_seconds("last")).withWatermark("ts", delay).groupBy("source")
    return watched.applyInPandasWithState(step, "source string, last_seen long, open boolean", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def stream_late_verdicts(requests: DataFrame, results: DataFrame, days: int = 25, delay: str = "1 day") -> DataFrame:
    """requests(item_id, content_hash, ts) with the verdict of the same content version that came within `days`; a request whose time is over comes out without one and may be asked again."""
    left = requests.withWatermark("ts", delay).alias("q")
    right = results.select("item_id", "content_hash", F.col("ts").alias("r_ts"), "verdict").withWatermark("r_ts", delay).alias("r")
    same = F.expr(f"q.item_id = r.item_id and q.content_hash = r.content_hash and r_ts >= q.ts and r_ts <= q.ts + interval {days} days")
    return left.join(right, same, "leftOuter").select("q.item_id", "q.content_hash", "q.ts", "verdict")


def stream_page_watch(stream: DataFrame, folder: str | None = None, parts: int = 256) -> DataFrame:
    """pages(url, hash, is_shell, extracted) batch by batch against the state that the batches before have left in a PartedTable,
    of which a batch reads and writes only the parts its urls fall into; a replay reads and writes the same versions, also
    after a restart with the same folder."""
    spark = stream.sparkSession
    folder = folder or work_folder(spark)

    def run(batch: DataFrame, batch_id: int) -> None:
        state = PartedTable(batch.sparkSession, f"{folder}/state", "url", "url string, hash string", parts)
        batch = batch.persist()  # the source is read once
        touched = state.touched(batch)
        outcome, after = detect_page_changes(batch, state.read(batch_id, touched))
        outcome.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")
        state.write(batch_id, touched, after)
        batch.unpersist()

    q = stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch")
