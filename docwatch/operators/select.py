"""Filters and selection. Clocks are parameters (as_of, today), never the wall clock."""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docwatch.operators.checkpoints import checkpointed


def union_ids(*ids: DataFrame) -> DataFrame:
    """distinct ids of several one-column tables."""
    return reduce(DataFrame.union, ids).distinct()


def without(df: DataFrame, key: str, *known: DataFrame) -> DataFrame:
    """Rows whose key is in none of the one-column tables. Rows without a key stay."""
    for ids in known:
        df = df.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_anti")
    return df


def in_window(date: Column, since, today) -> Column:
    """A missing date passes; the floor is inclusive; the future doesn't pass."""
    return date.isNull() | ((date >= F.lit(since).cast("date")) & (date <= F.lit(today).cast("date")))


def first_per_key(df: DataFrame, key: str, *order) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def select_candidates(df: DataFrame, known: list[DataFrame], since, today, exempt: list[str]) -> tuple[DataFrame, DataFrame]:
    """candidates(item_id, source, date, ingest_seq) that are new, in the window unless their source is exempt, and
    first of their id; and per source how many never-seen ids were lost to the floor, not counting ids selected
    through another copy."""
    fresh = without(df.where("item_id is not null"), "item_id", *known)
    future = F.col("date") > F.lit(today).cast("date")
    passes = ~F.coalesce(future, F.lit(False)) & (in_window(F.col("date"), since, today) | F.col("source").isin(exempt))
    chosen = first_per_key(fresh.where(passes), "item_id", "ingest_seq")
    below = fresh.where(~passes & ~F.coalesce(future, F.lit(False)))
    lost = without(below, "item_id", chosen.select("item_id")).groupBy("source").agg(F.countDistinct("item_id").alias("floored"))
    return chosen, lost


def since_date(last_filed, today, back: int = 2, default_back: int = 21) -> Column:
    """The floor: two days before the last filed date, else three weeks ago; never after today."""
    day = F.lit(today).cast("date")
    return F.least(day, F.coalesce(F.date_sub(F.lit(last_filed).cast("date"), back), F.date_sub(day, default_back)))


def admit_backlog(df: DataFrame, mark: int, since, known: list[DataFrame], k: int) -> tuple[DataFrame, DataFrame]:
    """Never-seen rows above the mark but under the floor: the k oldest ids are admitted, the others wait."""
    rows = without(df.where((F.col("item_id") > mark) & (F.col("date") < F.lit(since).cast("date"))), "item_id", *known)
    admitted = rows.orderBy("item_id").limit(k)
    return admitted, without(rows, "item_id", admitted.select("item_id"))


def moved_records(df: DataFrame, seen: DataFrame, statuses: list, excluded_prefix: str, number: str = "number") -> DataFrame:
    """Records in a wanted status whose id is new or whose change token differs; seen(item_id, token)."""
    old = seen.select("item_id", F.col("token").alias("__token"), F.lit(True).alias("__seen"))
    rows = df.where(F.col("status").isin(statuses) & ~F.coalesce(F.col(number).startswith(excluded_prefix), F.lit(False))).join(old, "item_id", "left")
    return rows.where(F.col("__seen").isNull() | ~F.col("__token").eqNullSafe(F.col("token"))).withColumn("is_new", F.col("__seen").isNull()).drop("__token", "__seen")


def active_periods(df: DataFrame, last_year: str, this_year: int, key: str) -> DataFrame:
    """Sessions whose last year reaches back two years at most; an unreadable year stays; newest first."""
    year = F.col(last_year).try_cast("int")
    return df.where(F.coalesce(year >= this_year - 1, F.lit(True))).orderBy(year.desc_nulls_first(), F.desc(key))


def display_window(df: DataFrame, date: str, today, years: int = 2) -> DataFrame:
    """in_window says whether a row is shown or belongs in the archive. 29 February is clamped."""
    return df.withColumn("in_window", F.coalesce(F.col(date) >= F.add_months(F.lit(today).cast("date"), -12 * years), F.lit(True)))


def whats_new(feed: DataFrame, since, kinds: list[str] | None, areas: list[str] | None, offset: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """The page of feed(item_id, kind, areas, changed) rows changed strictly after the cursor, newest first, and (total, has_more)."""
    rows = feed if since is None else feed.where(F.col("changed") > F.lit(since).cast("date"))
    rows = rows if kinds is None else rows.where(F.col("kind").isin(kinds))
    rows = rows if areas is None else rows.where(F.arrays_overlap("areas", F.array(*map(F.lit, areas))))
    page = rows.orderBy(F.desc("changed"), F.desc("item_id")).offset(offset).limit(limit)
    return page, rows.agg(F.count("*").alias("total"), (F.count("*") > offset + limit).alias("has_more"))


def area_coverage(feed: DataFrame) -> DataFrame:
    """(area, n) of a whole feed(areas): the denominators that go with every page of changes, whatever the page is filtered by. A row counts
    once in each of its areas; areas are compared in lower case."""
    return feed.select(F.explode(F.array_distinct(F.transform("areas", F.lower))).alias("area")).groupBy("area").agg(F.count("*").alias("n"))


def positions(df: DataFrame, group: list[str], order: list, name: str = "position", ranges: int | None = None, rows_per_range: int = 100_000) -> DataFrame:
    """df with the 1-based position (long) of each row in its group, without a task that holds a whole group: rows are dealt by
    ranges of (group, order), numbered inside their range, and shifted by the counts of the group's ranges before. There
    are as many ranges as rows_per_range asks for, so a range stays as large as it is while the data grow. Null group values are a
    group; rows that `order` doesn't tell apart come in any order."""
    ranges = ranges or max(1, ceil(df.count() / rows_per_range))
    dealt = checkpointed(df.repartitionByRange(ranges, *group, *order).withColumn("__range", F.spark_partition_id()))
    held = dealt.groupBy(*group, "__range").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range at most
    before = held.select(*(F.col(g).alias(f"__g_{g}") for g in group), F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    same = reduce(Column.__and__, (F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in group), F.col("__range") == F.col("__r"))
    inside = F.row_number().over(Window.partitionBy(*group, "__range").orderBy(*order))
    return dealt.withColumn("__inside", inside).join(before, same).withColumn(name, F.col("__inside") + F.col("__before")).select(*df.columns, name)


def distributed_rank(df: DataFrame, key: str, ranges: int | None = None) -> DataFrame:
    """0-based rank of distinct ids without a global window (see positions)."""
    return positions(df, [], [key], "rank", ranges).withColumn("rank", F.col("rank") - 1)


def rotating_slice(df: DataFrame, key: str, k: int, epoch_day: int) -> DataFrame:
    """K rows from position (epoch_day * k) mod n in id order, wrapping; no cursor is stored."""
    n = df.count()
    if not n:
        return df
    start = epoch_day * k % n
    return distributed_rank(df, key).where(F.pmod(F.col("rank") - start, F.lit(n)) < k).drop("rank")


def escalate_suspects(drops: DataFrame, verdicts: DataFrame, cap: int) -> DataFrame:
    """drops(item_id, reason, seq) with smell: an empty reason is suspect; a judged row has its verdict; un-judged rows none; suspects past the cap are `capped`. seq is unique."""
    rows = drops.join(verdicts.select("item_id", F.col("verdict").alias("__v")), "item_id", "left")
    raw = F.when(F.coalesce(F.trim("reason"), F.lit("")) == "", F.lit("suspect")).otherwise(F.col("__v"))
    rows = rows.withColumn("smell", raw).drop("__v")
    first = rows.where("smell = 'suspect'").orderBy("seq", "item_id").limit(cap).select("seq", F.lit(True).alias("__first"))
    rows = rows.join(first, "seq", "left")
    return rows.withColumn("smell", F.when((F.col("smell") == "suspect") & F.col("__first").isNull(), F.lit("capped")).otherwise(F.col("smell"))).drop("__first")


def select_for_audit(log: DataFrame, stages: list[str], limit: int) -> DataFrame:
    """C11: rows of the stages that are unstamped or deferred and not yet audited to full depth; the most recent `limit`."""
    open_ = F.col("smell").isNull() | (F.col("smell_outcome") == "deferred")
    done = F.coalesce(F.col("audit_depth") == "full", F.lit(False))
    return log.where(F.col("stage").isin(stages) & F.coalesce(open_, F.lit(False)) & ~done).orderBy(F.desc("seq")).limit(limit)


def abandoned_due(df: DataFrame, known: list[DataFrame], today, days: int, k: int) -> DataFrame:
    """Given-up items(item_id, last_try) due for another try, oldest first."""
    due = F.col("last_try").isNull() | (F.col("last_try") <= F.date_sub(F.lit(today).cast("date"), days))
    return without(df.where(due), "item_id", *known).orderBy(F.col("last_try").asc_nulls_first(), "item_id").limit(k)


def closed_category_check(log: DataFrame, allowed: DataFrame) -> DataFrame:
    """C14: category_invalid where the stage has a list, allowed(stage, category), and the row's category isn't on it."""
    listed = allowed.select("stage").distinct().withColumn("__listed", F.lit(True))
    pair = allowed.select("stage", "category").distinct().withColumn("__ok", F.lit(True))
    rows = log.join(listed, "stage", "left").join(pair, ["stage", "category"], "left")
    return rows.withColumn("category_invalid", F.col("__listed").isNotNull() & F.col("__ok").isNull()).drop("__listed", "__ok")


def reasons(**conditions: Column) -> Column:
    """Sorted array of the names whose condition holds."""
    return F.array_sort(F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in conditions.items())), lambda x: x.isNotNull()))


def flagged(items: DataFrame) -> DataFrame:
    """items(item_id, status, treatment_date, date) whose status isn't ok, newest flag first."""
    return items.where("status <> 'ok'").withColumn("flag_date", F.coalesce("treatment_date", "date")).orderBy(F.desc("flag_date"), F.desc("item_id"))


def digest_select(items: DataFrame, today, days: int) -> DataFrame:
    """C17: section new (by first_seen, else date) and correction (by treatment date) of the window; the window's start is inclusive."""
    start = F.date_sub(F.lit(today).cast("date"), days)
    new = items.where(F.coalesce("first_seen", "date") >= start).select(F.lit("new").alias("section"), "item_id", F.coalesce("first_seen", "date").alias("day"))
    fixed = items.where((F.col("status") != "ok") & (F.col("treatment_date") >= start)).select(F.lit("correction").alias("section"), "item_id", F.col("treatment_date").alias("day"))
    return new.union(fixed)


def digest_watches(watches: DataFrame, today, days: int) -> DataFrame:
    """C17: counts per kind of watches(kind, first_seen, date) in the window; kinds without a row are left out."""
    return watches.where(F.coalesce("first_seen", "date") >= F.date_sub(F.lit(today).cast("date"), days)).groupBy("kind").agg(F.count("*").alias("n"))


def ordered(df: DataFrame, date: str = "date", key: str = "item_id") -> DataFrame:
    """newest first, ties by id."""
    return df.orderBy(F.desc(date), F.desc(key))


def cap_per_group(df: DataFrame, group: str, n: int, total: int, *order) -> DataFrame:
    """the first n rows per group, then the first `total` of all."""
    kept = df.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__n") <= n).drop("__n")
    return kept.orderBy(*order).limit(total)
