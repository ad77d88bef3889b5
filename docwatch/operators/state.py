"""Windows over logs, keyed state and merges, in batch form. Clocks are parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docwatch.functions import values
from docwatch.operators.checkpoints import checkpointed
from docwatch.operators.select import first_per_key, union_ids, without


def change_event(items: DataFrame) -> DataFrame:
    """changed is the later of first_seen and treatment_date (change new or treatment), else the date."""
    treated = F.coalesce(F.col("treatment_date") > F.coalesce("first_seen", "date"), F.lit(False))
    return items.withColumn("changed", F.when(treated, F.col("treatment_date")).otherwise(F.coalesce("first_seen", "date"))).withColumn("change", F.when(treated, "treatment").otherwise("new"))


def rolling_usage(events: DataFrame, account: str, ts: str, budgets: dict[str, tuple[int, int]]) -> DataFrame:
    """calls in the trailing windows (name -> seconds, budget) before each call, the window that binds longest, and the seconds until a slot is free there.

    A window is strictly shorter than its span and leaves out the call itself. The timeline of an account is cut into
    stretches of the longest span; a call also visits the next stretch, where it is only looked back at, so that a
    busy account spreads over many tasks.
    """
    longest = max(seconds for seconds, _ in budgets.values()) * 1_000_000
    rows = events.withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("__own", F.floor(F.col("__us") / longest))
    rows = rows.withColumn("__at", F.explode(F.array("__own", F.col("__own") + 1)))
    part = [account, "__at"]
    waits = []
    for name, (seconds, budget) in budgets.items():
        span = Window.partitionBy(*part).orderBy("__us").rangeBetween(-seconds * 1_000_000 + 1, 0)
        # calls at the same instant count only if they come earlier by id
        later = F.count("*").over(Window.partitionBy(*part, "__us")) - F.row_number().over(Window.partitionBy(*part, "__us").orderBy("event_id"))
        rows = rows.withColumn(f"used_{name}", F.count("*").over(span) - 1 - later)
        freeing = F.lag("__us", budget).over(Window.partitionBy(*part).orderBy("__us", "event_id"))
        wait = F.when(F.col(f"used_{name}") >= budget, F.greatest(F.lit(0), F.ceil((freeing + seconds * 1_000_000 - F.col("__us")) / 1_000_000)))
        waits.append(F.struct(F.coalesce(wait, F.lit(0)).cast("long").alias("wait"), F.lit(name).alias("window")))
    rows = rows.withColumn("__w", F.greatest(*waits) if len(waits) > 1 else waits[0]).where("__at = __own")
    return rows.withColumn("wait_seconds", F.col("__w.wait")).withColumn("binding", F.when(F.col("__w.wait") > 0, F.col("__w.window"))).drop("__w", "__us", "__own", "__at")


def status_transition(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, before, after) for every field that differs, added and removed keys included."""
    o = old.select(F.col(key), *[F.col(f).cast("string").alias(f"o_{f}") for f in fields])
    n = new.select(F.col(key), *[F.col(f).cast("string").alias(f"n_{f}") for f in fields])
    changes = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"o_{f}").alias("before"), F.col(f"n_{f}").alias("after")) for f in fields])
    return o.join(n, key, "full").select(key, F.inline(changes)).where(~F.col("before").eqNullSafe(F.col("after")))


def stalled_runs(log: DataFrame, n: int, parts: int | None = None) -> DataFrame:
    """log(source, run, mark, blocked): length of each streak of runs with an unmoved mark and a blocker outstanding; loud from n on.

    Runs are dealt by ranges of (source, run), so one source's are spread over tasks. A stretch of them counts its streaks for
    itself and sums itself up in a row (first and last run, length, streak at its end, whether all of it is stuck); from these
    rows, a few per task, each stretch learns the streak that it goes on with."""
    parts = parts or int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(log.repartitionByRange(parts, "source", "run").withColumn("__part", F.spark_partition_id()))
    w = Window.partitionBy("source", "__part").orderBy("run")
    inner = F.coalesce(F.col("mark").eqNullSafe(F.lag("mark").over(w)) & F.col("blocked"), F.lit(False)) & (F.row_number().over(w) > 1)
    rows = dealt.withColumn("__stuck", inner).withColumn("__k", F.row_number().over(w))
    rows = rows.withColumn("__island", F.sum(F.when(F.col("__stuck"), 0).otherwise(1)).over(w))  # the first row opens island 1
    rows = checkpointed(rows.withColumn("__own", F.row_number().over(Window.partitionBy("source", "__part", "__island").orderBy("run")) - 1))

    ends = rows.groupBy("source", "__part").agg(
        F.min_by(F.struct("mark", "blocked"), "__k").alias("first"), F.max_by("mark", "__k").alias("last"), F.max("__k").alias("size"), F.max_by("__own", "__k").alias("tail"), F.max("__island").alias("islands")
    )
    order = Window.partitionBy("source").orderBy("__part")  # a row per task at most
    goes_on = F.lag(F.lit(True)).over(order) & F.col("first.mark").eqNullSafe(F.lag("last").over(order)) & F.col("first.blocked")
    ends = ends.withColumn("on", F.coalesce(goes_on, F.lit(False)))
    all_stuck = F.col("on") & (F.col("islands") == 1)
    ends = ends.withColumn("chain", F.sum(F.when(all_stuck, 0).otherwise(1)).over(order))
    adds = F.when(all_stuck, F.col("size")).otherwise(F.col("tail"))
    through = F.sum(adds).over(Window.partitionBy("source", "chain").orderBy("__part"))
    ends = ends.withColumn("through", through).withColumn("before", F.coalesce(F.lag("through").over(order), F.lit(0)))
    joined = rows.join(ends.select("source", "__part", "on", "before"), ["source", "__part"])
    streak = F.col("__own") + F.when((F.col("__island") == 1) & F.col("on"), F.col("before") + 1).otherwise(0)
    return joined.withColumn("streak", streak.cast("long")).withColumn("loud", F.col("streak") >= n).select(*log.columns, "streak", "loud")


def merge_items(existing: DataFrame, new: DataFrame, key: str, order: str, fields: list[str] | None = None) -> DataFrame:
    """Upsert. The last new row of a key wins, first_seen survives; action tells added, updated or kept. With
    fields, a row is only updated where one of them differs (status_transition lists the changes)."""
    columns = [c for c in existing.columns if c not in (key, "first_seen")]
    last = first_per_key(new, key, F.desc(order)).select(key, F.struct(*columns, "first_seen").alias("n"))
    both = existing.select(key, F.struct(*columns, "first_seen").alias("o")).join(last, key, "full")
    differs = F.lit(True) if fields is None else reduce(Column.__or__, (~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")) for f in fields))
    action = F.when(F.col("o").isNull(), "added").when(F.col("n").isNotNull() & differs, "updated").otherwise("kept")
    both = both.withColumn("action", action)
    pick = lambda c: F.when(F.col("action") == "kept", F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    return both.select(key, *map(pick, columns), F.coalesce("o.first_seen", "n.first_seen").alias("first_seen"), "action")


def merge_counts(merged: DataFrame) -> DataFrame:
    """G1: how many rows were added and updated."""
    return merged.agg(F.count_if(F.col("action") == "added").alias("added"), F.count_if(F.col("action") == "updated").alias("updated"))


def raise_flags(items: DataFrame, known: DataFrame, findings: DataFrame, adverse: tuple[str, ...] = values.ADVERSE_KINDS) -> tuple[DataFrame, DataFrame]:
    """findings(item_id, citer_id, kind, affects, date) of an adverse kind that affect the proposition, new against
    known(item_id, citer_id), one per citer; items(item_id, status, treatment_date) go from ok to caution, never down,
    and get the date on that transition only. Gives (items, treatments to append)."""
    new = findings.where(F.col("kind").isin(adverse) & F.col("affects")).join(known.select("item_id", "citer_id"), ["item_id", "citer_id"], "left_anti")
    new = new.withColumn("n", F.row_number().over(Window.partitionBy("item_id", "citer_id").orderBy("date", "kind"))).where("n = 1").drop("n")
    hit = new.groupBy("item_id").agg(F.max("date").alias("__date"), F.count("*").alias("__n"))
    rows = items.join(hit, "item_id", "left")
    raised = F.col("__n").isNotNull() & (F.coalesce("status", F.lit("ok")) == "ok")
    rows = rows.withColumn("treatment_date", F.when(raised, F.col("__date")).otherwise(F.col("treatment_date"))).withColumn("raised", raised)
    return rows.withColumn("status", F.when(F.col("raised"), "caution").otherwise(F.col("status"))).drop("__date", "__n"), new


DEPTHS = ("skim", "excerpt", "full")


def record_audits(log: DataFrame, batch: DataFrame, depths: tuple[str, ...] = DEPTHS) -> tuple[DataFrame, DataFrame]:
    """Stamps batch(key, verdict, depth) onto log(key, verdict, depth); a weaker depth never replaces a stronger one. Gives (log, outcome per batch row)."""
    rank = lambda c: F.array_position(F.array(*map(F.lit, depths)), F.coalesce(c, F.lit("")))
    best = first_per_key(batch, "key", F.desc(rank(F.col("depth"))), "verdict").select("key", F.col("verdict").alias("b_verdict"), F.col("depth").alias("b_depth"))
    joined = log.join(best, "key", "left")
    takes = F.col("b_verdict").isNotNull() & (rank(F.col("b_depth")) >= rank(F.col("depth")))
    stamped = joined.withColumn("verdict", F.when(takes, F.col("b_verdict")).otherwise(F.col("verdict"))).withColumn("depth", F.when(takes, F.col("b_depth")).otherwise(F.col("depth"))).drop("b_verdict", "b_depth")
    outcome = best.join(log.select("key", F.col("depth").alias("old"), F.lit(True).alias("found")), "key", "left")
    outcome = outcome.select("key", F.when(F.col("found").isNull(), "missing").when(rank(F.col("b_depth")) >= rank(F.col("old")), "applied").otherwise("skipped").alias("outcome"))
    return stamped, outcome


def detect_page_changes(pages: DataFrame, state: DataFrame, key: tuple[str, ...] = ("url",)) -> tuple[DataFrame, DataFrame]:
    """pages(url, hash, is_shell, extracted) against state(url, hash): unreachable, shell, unchanged or changed; the next state has a new hash only where extraction succeeded.
    The columns of key, which both have, tell one page from another; a table that holds a url more than once needs more than the url."""
    rows = pages.join(state.select(*key, F.col("hash").alias("old")), list(key), "left")
    outcome = F.when(F.col("hash").isNull(), "unreachable").when(F.col("is_shell"), "shell").when(F.col("hash").eqNullSafe(F.col("old")), "unchanged").otherwise("changed")
    rows = rows.withColumn("outcome", outcome)
    kept = F.when((F.col("outcome") == "changed") & F.col("extracted"), F.col("hash")).otherwise(F.col("old"))
    unseen = state.join(pages.select(*key), list(key), "left_anti")
    return rows.select(*key, "outcome"), rows.select(*key, kept.alias("hash")).where("hash is not null").union(unseen.select(*key, "hash"))


def advance_mark(mark: int, found: DataFrame, resolved: DataFrame, waiting: DataFrame, tries: DataFrame, failed: DataFrame, covered: int | None, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The next mark (one row), the ids given up on (item_id) and the next tries(item_id, n).

    The mark rises to the highest found id, of an incomplete listing to the bound that it covered, but stops just below the
    lowest found id that is outstanding: above the mark, not resolved, not given up. Only failed(item_id) ids spend a try; a
    waiting one spends none and isn't given up; with `most` tries an id is given up, whether it failed now or before. Tries
    of ids that were not found are carried; those up to the new mark are forgotten."""
    flag = lambda df, name: df.select("item_id", F.lit(True).alias(name)).distinct()
    now = found.select("item_id").distinct().join(tries.select("item_id", "n"), "item_id", "left")
    for df, name in ((resolved, "done"), (waiting, "waits"), (failed, "failed")):
        now = now.join(flag(df, name), "item_id", "left")
    now = now.withColumn("spent", F.coalesce("n", F.lit(0)) + F.when(F.col("failed") & F.col("waits").isNull(), 1).otherwise(0))
    is_open = (F.col("item_id") > mark) & F.col("done").isNull()
    now = now.withColumn("gave", is_open & F.col("waits").isNull() & (F.col("spent") >= most))
    lowest = F.min(F.when(is_open & ~F.col("gave"), F.col("item_id"))) - 1
    top = F.lit(covered) if covered is not None else F.coalesce(F.max("item_id"), F.lit(mark))
    after = now.agg(F.greatest(F.lit(mark), F.least(top, lowest)).cast("long").alias("mark"))
    kept = now.where(is_open & ~F.col("gave") & F.col("waits").isNull() & (F.col("spent") > 0)).select("item_id", F.col("spent").cast("long").alias("n"))
    carried = without(tries.select("item_id", F.col("n").cast("long").alias("n")), "item_id", found)
    left = kept.union(carried).join(F.broadcast(after.withColumnRenamed("mark", "__m")), F.col("item_id") > F.col("__m")).select("item_id", "n")  # one row
    return after, now.where("gave").select("item_id"), left


def update_abandoned(listed: DataFrame, gave_up: DataFrame, retried: DataFrame, resolved: DataFrame, today) -> DataFrame:
    """listed(item_id, reason, retries, last_try) after a run: resolved ids leave; retried(item_id, reason) ones count a retry and
    take today and their new reason, if any; gave_up(item_id, reason) ids that are not listed by then come in with no retry."""
    day = F.lit(today).cast("date")
    left = without(listed, "item_id", resolved).join(retried.select("item_id", F.col("reason").alias("new"), F.lit(1).alias("r")), "item_id", "left")
    retries = F.coalesce("retries", F.lit(0)) + F.coalesce("r", F.lit(0))
    kept = left.select("item_id", F.coalesce("new", "reason").alias("reason"), retries.alias("retries"), F.when(F.col("r").isNotNull(), day).otherwise(F.col("last_try")).alias("last_try"))
    fresh = without(gave_up, "item_id", kept)
    return kept.union(fresh.select("item_id", "reason", F.lit(0), day))


def retry_pending(pending: DataFrame, attempted: DataFrame, succeeded: DataFrame, no_text: DataFrame, stopped: bool, today, max_tries: int = 4, text_weeks: int = 8) -> DataFrame:
    """pending(item_id, citer_id, tries, text_since) after a run: action retry, done or manual. A failure costs a try
    unless the run was stopped, and ends the wait for a text; a missing text costs none but runs on a clock of text_weeks
    from its first day. What the run did not reach stays as it is. A pair that is new in this run is never given up at once."""
    key = ["item_id", "citer_id"]
    flag = lambda df, name: df.select(*key, F.lit(True).alias(name)).distinct()
    ids = union_ids(pending.select(*key), attempted.select(*key), no_text.select(*key))
    rows = ids.join(pending.withColumn("p", F.lit(True)), key, "left").join(flag(attempted, "a"), key, "left").join(flag(succeeded, "s"), key, "left").join(flag(no_text, "x"), key, "left")
    day = F.lit(today).cast("date")
    there = lambda c: F.col(c).isNotNull()
    failed = there("a") & ~there("s") & ~there("x")
    tries = F.coalesce("tries", F.lit(0)) + F.when(failed & F.lit(not stopped), 1).otherwise(0)
    since = F.when(there("x"), F.coalesce("text_since", day)).when(~failed, F.col("text_since"))
    waited = there("x") & (F.date_diff(day, F.col("text_since")) >= 7 * text_weeks)
    manual = there("p") & (F.coalesce(waited, F.lit(False)) | (failed & F.lit(not stopped) & (tries >= max_tries)))
    action = F.when(there("s"), "done").when(manual, "manual").otherwise("retry")
    return rows.select(*key, tries.alias("tries"), since.alias("text_since"), action.alias("action"))


def sweep_state(sweep: DataFrame, run: DataFrame) -> DataFrame:
    """sweep(item_id, full) after run(item_id, stopped, truncated): full once a pass was neither stopped nor truncated, and full for good."""
    now = run.groupBy("item_id").agg((~F.max(F.col("stopped") | F.col("truncated"))).alias("now"))
    return sweep.join(now, "item_id", "full").select("item_id", (F.coalesce("full", F.lit(False)) | F.coalesce("now", F.lit(False))).alias("full"))


def two_strike(state: DataFrame, failures: DataFrame, now: int, wait: int = 86_400) -> DataFrame:
    """state(url, first_failed, last_failed, confirmed_at) after a run with failures(url): a failing url
    becomes a suspect with a clock; one that is not among the failures, healthy or no longer checked, leaves; it is due after `wait` seconds and confirmed if it fails again then."""
    rows = failures.select("url").distinct().join(state, "url", "left")
    due = F.col("first_failed").isNotNull() & (F.lit(now) - F.col("first_failed") >= wait)
    time = F.lit(now).cast("long")
    confirmed = F.coalesce("confirmed_at", F.when(due, time))
    return rows.select("url", F.coalesce("first_failed", time).alias("first_failed"), time.alias("last_failed"), confirmed.alias("confirmed_at"), F.coalesce(due, F.lit(False)).alias("due"))


def route(items: DataFrame, cleared: DataFrame, **holds: Column) -> DataFrame:
    """Lane auto or held with the sorted hold reasons; cleared(item_id) holds go to auto, except a treatment change, which is always held."""
    found = F.array_sort(F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in holds.items())), lambda x: x.isNotNull()))
    rows = items.withColumn("reasons", found).join(cleared.select("item_id", F.lit(True).alias("__c")).distinct(), "item_id", "left")
    held = (F.size("reasons") > 0) & (F.col("__c").isNull() | F.array_contains("reasons", "treatment"))
    return rows.withColumn("lane", F.when(held, "held").otherwise("auto")).drop("__c")


def reconcile_review(pending: DataFrame, staged: DataFrame, decisions: DataFrame, published: DataFrame, merged: bool = True) -> DataFrame:
    """(item_id, outcome) of a review batch that was merged, for pending(item_id) and staged(item_id, card_id).

    What is still staged is accepted: a new card (card_id null) that isn't published(item_id) yet, or a change to card_id, if
    that is published or accepted with it. decisions(item_id, decision) block a case even if its file was restored. A
    pending case that isn't accepted is declined (stays seen) by that decision, else vetoed (may come again). A staged
    case that is neither accepted nor pending is skipped. A batch closed without a merge vetoes all that is pending.
    Applied again, with the ids accepted before among the published and none pending, it accepts no card twice."""
    one = lambda df: df.select("item_id").distinct()
    if not merged:
        return one(pending).withColumn("outcome", F.lit("vetoed"))
    blocked = one(decisions.where(F.col("decision").isin("veto", "decline")))
    free = without(staged.select("item_id", "card_id"), "item_id", blocked)
    cards = one(without(free.where("card_id is null"), "item_id", published))
    live = union_ids(one(published), cards).toDF("card_id")
    accepted = union_ids(cards, one(free.join(live, "card_id", "left_semi")))
    flag = lambda df, name: one(df).withColumn(name, F.lit(True))
    rows = union_ids(one(pending), one(staged))
    for df, name in ((accepted, "a"), (decisions.where("decision = 'decline'"), "d"), (pending, "p")):
        rows = rows.join(flag(df, name), "item_id", "left")
    outcome = F.when(F.col("a"), "accepted").when(F.col("p").isNull(), "skipped").when(F.col("d"), "declined").otherwise("vetoed")
    return rows.select("item_id", outcome.alias("outcome"))


def advance_seen(cap: int, held: DataFrame, *ids: DataFrame) -> DataFrame:
    """Union of the id sets without the held ones; the `cap` largest ids stay."""
    return without(union_ids(*ids).toDF("item_id"), "item_id", held).orderBy(F.desc("item_id")).limit(cap)


def input_fingerprint(*columns: str | Column) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def memo_verdicts(requests: DataFrame, memo: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests(…, fingerprint) answered from memo(fingerprint, verdict), and the misses, which alone go to the classifier."""
    best = memo.groupBy("fingerprint").agg(F.max("verdict").alias("verdict"))
    rows = requests.join(best, "fingerprint", "left")
    return rows.where("verdict is not null"), rows.where("verdict is null").drop("verdict")


def health_report(status: DataFrame, items: DataFrame, now, stale_hours: int = 36, content_days: int = 30) -> DataFrame:
    """status(scanned_at), items(content_at), both strings, to one row: ages, stale, trust_silence and a code: 0 fine, 3 stale or old, 4 unreadable, or content without any readable date."""
    at = F.lit(now).cast("timestamp")
    hours = lambda c: F.round((F.unix_timestamp(at) - F.unix_timestamp(c)) / 3600, 1)
    scan = status.agg(F.max(F.try_to_timestamp("scanned_at")).alias("scanned"))
    content = items.agg(F.count("*").alias("rows"), F.count(F.try_to_timestamp("content_at")).alias("dated"), F.max(F.try_to_timestamp("content_at")).alias("latest"))
    one = scan.join(F.broadcast(content))  # two one-row tables
    one = one.withColumn("scan_age_h", hours(F.col("scanned"))).withColumn("content_age_h", hours(F.col("latest")))
    one = one.withColumn("stale", F.coalesce(F.col("scan_age_h") > stale_hours, F.lit(True)))
    code = F.when(F.col("scanned").isNull() | ((F.col("rows") > 0) & (F.col("dated") == 0)), 4).when(F.col("stale") | (F.col("content_age_h") > content_days * 24), 3).otherwise(0)
    return one.select("scan_age_h", "content_age_h", "rows", "dated", "stale", (~F.col("stale")).alias("trust_silence"), code.alias("code"))


def settle_outcomes(log: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Later outcomes(stage, item_id, ts, outcome) stamped onto log rows of the same triple; outcomes whose row has aged out do nothing, and settling twice changes nothing."""
    last = outcomes.groupBy("stage", "item_id", "ts").agg(F.max("outcome").alias("__o"))
    return log.join(last, ["stage", "item_id", "ts"], "left").withColumn("outcome", F.coalesce("__o", "outcome")).drop("__o")


def stamp_forced(log: DataFrame, stamps: DataFrame, by: str, at) -> DataFrame:
    """What a forced read of the whole text found, stamps(item_id, verdict, note), onto every row of the item in log(item_id,
    audit_verdict, audit_depth, audit_by, audited_at, audit_note). A full read replaces any other; several stamps of an item leave the one
    with the largest note, then verdict; items without a row do nothing. at is the run's time, so stamping the same run
    again changes nothing. C11 selects no row that carries such a stamp, also where its outcome is still `deferred`."""
    last = stamps.groupBy("item_id").agg(F.max(F.struct(F.coalesce("note", F.lit("")).alias("note"), "verdict")).alias("__s"))
    new = {"audit_verdict": F.col("__s.verdict"), "audit_depth": F.lit("full"), "audit_by": F.lit(by), "audited_at": F.lit(at).cast("string"), "audit_note": F.nullif(F.col("__s.note"), F.lit(""))}
    rows = log.join(last, "item_id", "left")
    return rows.withColumns({c: F.when(F.col("__s").isNotNull(), v).otherwise(F.col(c)) for c, v in new.items()}).select(*log.columns)


def reference_health(tables: DataFrame, entries: DataFrame, now, max_days: int) -> DataFrame:
    """Reference tables(name, generated_at), a string, with their entries(name): (name, entries, age_days, code). 5 is an alert: no
    readable date, dated but empty, or older than max_days; 0 is fine. A table that is absent is not in use and has no row, one of
    which there are only entries has no date. max_days of 0 switches the check off: no rows."""
    held = entries.groupBy("name").agg(F.count("*").alias("entries"))
    dated = tables.groupBy("name").agg(F.max(F.try_to_timestamp("generated_at")).alias("at"))
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("at")) / 86_400
    rows = dated.join(held, "name", "full").withColumn("entries", F.coalesce("entries", F.lit(0)).cast("long")).withColumn("age_days", F.round(age, 1))
    code = F.when(F.col("at").isNull() | (F.col("entries") == 0) | (age > max_days), 5).otherwise(0)
    return rows.where(F.lit(max_days > 0)).select("name", "entries", "age_days", code.alias("code"))
