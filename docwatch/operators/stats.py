"""Aggregations: coverage, drops, audits, gates, consensus, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docwatch.functions import values
from docwatch.operators.select import positions


def corpus_stats(items: DataFrame) -> DataFrame:
    """items(item_id, date, source, disposition, status, tags) to a tidy (dimension, value, n): totals, date span,
    flagged, and counts by year, source, disposition, status and tag; a blank status is `published`."""
    rows = items.select(F.year("date").cast("string").alias("year"), "source", "disposition", F.coalesce(F.nullif(F.trim("status"), F.lit("")), F.lit("published")).alias("status"), "date", "tags")
    sets = rows.groupingSets([["year"], ["source"], ["disposition"], ["status"]], "year", "source", "disposition", "status").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    name = F.when(F.col("g") == 7, "year").when(F.col("g") == 11, "source").when(F.col("g") == 13, "disposition").otherwise("status")
    value = F.when(F.col("g") == 7, F.col("year")).when(F.col("g") == 11, F.col("source")).when(F.col("g") == 13, F.col("disposition")).otherwise(F.col("status"))
    tags = rows.select(F.explode("tags").alias("t")).groupBy("t").count().select(F.lit("tag").alias("dimension"), F.col("t").alias("value"), F.col("count").alias("n"))
    one = rows.agg(F.count("*").alias("n"), F.count_if(~F.col("status").isin("ok", "published")).alias("flagged"), F.min("date").cast("string").alias("first"), F.max("date").cast("string").alias("last"))
    row = lambda dimension, value, n: F.struct(F.lit(dimension).alias("dimension"), value.alias("value"), n.cast("long").alias("n"))
    none = F.lit(None)
    total = one.select(F.inline(F.array(row("total", F.lit("items"), F.col("n")), row("total", F.lit("flagged"), F.col("flagged")), row("first", F.col("first"), none), row("last", F.col("last"), none))))
    return sets.select(name.alias("dimension"), value.alias("value"), "n").union(tags).union(total)


def drop_counts(df: DataFrame, reason: str, prefixes: list[tuple[str, str]] = values.DROP_TIERS) -> DataFrame:
    """Drops per tier, by the first prefix (prefix, tier) of the reason, else other."""
    chain: Column = F.lit("other")
    for prefix, tier in reversed(prefixes):
        chain = F.when(F.col(reason).startswith(prefix), F.lit(tier)).otherwise(chain)
    return df.groupBy(chain.alias("tier")).agg(F.count("*").alias("n"))


def category_counts(log: DataFrame, stage: str | None = None) -> DataFrame:
    """log(stage, category, category_invalid): rows per category, how many invalid; untokened ones under null."""
    rows = log if stage is None else log.where(F.col("stage") == stage)
    return rows.groupBy(F.nullif(F.trim("category"), F.lit("")).alias("category")).agg(F.count("*").alias("n"), F.count_if("category_invalid").alias("invalid"))


def audit_summary(log: DataFrame) -> DataFrame:
    """log(verdict, depth): counts by verdict, by depth, and of unaudited rows, as (dimension, value, n)."""
    sets = log.where("verdict is not null").groupingSets([["verdict"], ["depth"]], "verdict", "depth").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    stamped = sets.select(F.when(F.col("g") == 1, "verdict").otherwise("depth").alias("dimension"), F.when(F.col("g") == 1, F.col("verdict")).otherwise(F.col("depth")).alias("value"), "n")
    return stamped.union(log.agg(F.lit("unaudited").alias("dimension"), F.lit(None).cast("string").alias("value"), F.count_if(F.col("verdict").isNull()).alias("n")))


def run_record(log: DataFrame, floored: DataFrame | None = None) -> DataFrame:
    """E5: one row for a run's log(tier, dropped): screened, dropped, carded and a map of drops per tier; with
    floored(source, floored) also the map `floors` of ids lost to the floor per source."""
    per = log.groupBy("tier").agg(F.count("*").alias("n"), F.count_if("dropped").alias("d"))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    pairs = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(c) > 0, F.struct("tier", c)))))
    out = [total("n", "screened"), total("d", "dropped"), total(F.col("n") - F.col("d"), "carded"), pairs("d").alias("drops")]
    if floored is not None:
        per = per.unionByName(floored.select(F.col("source").alias("tier"), "floored"), allowMissingColumns=True)
        out.append(pairs("floored").alias("floors"))
    return per.agg(*out)


def tag_coverage(df: DataFrame, tags: str) -> DataFrame:
    """Rows per tag, most frequent first, then by name."""
    return df.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


def feed_document(cards: DataFrame, watches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cards and watches in one shape, absent fields null, and the counts per kind."""
    both = cards.unionByName(watches, allowMissingColumns=True)
    return both, both.groupBy("kind").agg(F.count("*").alias("n"))


def evaluate_gate(golden: DataFrame, verdicts: DataFrame, exempt: list[str]) -> tuple[DataFrame, DataFrame]:
    """golden(item_id, source, expect_relevant) against verdicts(item_id, tier1, tier2, significance): outcome per
    case, and one summary row that fails closed: no case checked is a failure too."""
    v = verdicts.select("item_id", "tier1", "tier2", "significance", F.lit(True).alias("cached"))
    keep = (F.col("source").isin(exempt) | F.col("tier1")) & F.col("tier2") & (F.coalesce("significance", F.lit("")) != "low")
    rows = golden.join(v, "item_id", "left").withColumn("kept", F.coalesce(keep, F.lit(False)))
    rows = rows.withColumn("outcome", F.when(F.col("cached").isNull(), "uncached").when(F.col("kept") == F.col("expect_relevant"), "ok").otherwise("regression"))
    count = lambda x: F.count_if(F.col("outcome") == x)
    one = rows.agg(count("ok").alias("ok"), count("regression").alias("regression"), count("uncached").alias("uncached"))
    return rows.select("item_id", "outcome"), one.withColumn("passed", (F.col("ok") > 0) & (F.col("regression") == 0) & (F.col("uncached") == 0))


def gate_recall(golden: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Keepers passed and missed, and how many controls are filtered; verdicts(item_id, kept)."""
    rows = golden.join(verdicts.select("item_id", "kept"), "item_id")
    n = lambda c: F.count_if(c)
    out = rows.agg(n(F.col("expect_relevant") & F.col("kept")).alias("passed"), n(F.col("expect_relevant") & ~F.col("kept")).alias("missed"), n(~F.col("expect_relevant") & ~F.col("kept")).alias("filtered"), n(~F.col("expect_relevant")).alias("controls"))
    return out.withColumn("filter_rate", F.when(F.col("controls") > 0, F.col("filtered") / F.col("controls")))


def consensus(attempts: DataFrame, tries: int) -> DataFrame:
    """attempts(item, attempt, vote, reason) to one outcome per item: a majority of the attempts budgeted, not of those returned; the reason is the last flag's."""
    half = tries // 2
    rows = attempts.groupBy("item").agg(F.count_if(F.col("vote") != "lost").alias("returned"), F.count_if(F.col("vote") == "flag").alias("flags"), F.count_if(F.col("vote") == "clear").alias("clears"), F.max_by(F.when(F.col("vote") == "flag", F.col("reason")), F.when(F.col("vote") == "flag", F.col("attempt"))).alias("reason"))
    outcome = F.when(F.col("returned") == 0, "unavailable").when(F.col("flags") > half, "flag").when(F.col("clears") > half, "clear").otherwise("unavailable")
    return rows.withColumn("outcome", outcome).withColumn("reason", F.when(F.col("outcome") == "flag", F.col("reason")))


def weekly_digest(items: DataFrame) -> DataFrame:
    """(week, list, position, item_id): per Monday the new ids by first_seen and the flagged ids by treatment_date, each list newest first."""
    new = items.select(F.to_date(F.date_trunc("week", "first_seen")).alias("week"), F.lit("new").alias("list"), F.col("first_seen").alias("day"), "item_id")
    flags = items.where("status <> 'ok' and treatment_date is not null").select(F.to_date(F.date_trunc("week", "treatment_date")).alias("week"), F.lit("flag").alias("list"), F.col("treatment_date").alias("day"), "item_id")
    rows = new.union(flags).where("week is not null")
    return positions(rows, ["week", "list"], [F.desc("day"), F.desc("item_id")]).select("week", "list", "position", "item_id")


def thin_coverage(added: DataFrame, golden: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Tags of added(item_id, tags, clean) with fewer than `least` positive anchors in golden(item_id, tags, expect_relevant); and the clean rows that cover them."""
    anchors = golden.where("expect_relevant").select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("anchors"))
    tags = added.select(F.explode("tags").alias("tag")).distinct()
    thin = tags.join(anchors, "tag", "left").select("tag", F.coalesce("anchors", F.lit(0)).cast("long").alias("anchors")).where(F.col("anchors") < least)
    covers = added.where("clean").select("item_id", F.explode("tags").alias("tag")).join(thin, "tag").groupBy("item_id").agg(F.array_sort(F.collect_set("tag")).alias("covers"))
    return thin, covers


def feed_shape(raw: DataFrame, parsed: DataFrame, feeds: DataFrame | None = None, fleet: list[str] = []) -> tuple[DataFrame, DataFrame]:
    """Entries against parsed rows per source with a status (ok, empty, no-candidates), and one code, per fleet of
    sources if columns name one: 0 healthy (a source yields candidates), 3 drift (entries, but none parsed anywhere), 4 soft
    (nothing to assess). feeds(source) lists sources that may have no entry at all."""
    by = [*fleet, "source"]
    count = lambda df, name: df.groupBy(*by).agg(F.count("*").alias(name))
    both = count(raw, "entries").join(count(parsed, "parsed"), by, "full")
    if feeds is not None:
        both = both.join(feeds.select(*by).distinct(), by, "full")
    per = both.select(*by, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("entries", "parsed")))
    per = per.withColumn("status", F.when(F.col("parsed") > 0, "ok").when(F.col("entries") == 0, "empty").otherwise("no-candidates"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    code = F.when(total("parsed") > 0, 0).when(total("entries") > 0, 3).otherwise(4)
    return per, (per.groupBy(*fleet) if fleet else per).agg(code.alias("code"))


def sweep_report(df: DataFrame, status: str, tier: str) -> DataFrame:
    """Rows per status and tier, and per status over all tiers (tier null)."""
    return df.groupingSets([[status, tier], [status]], status, tier).agg(F.count("*").alias("n")).select(F.col(status).alias("status"), F.col(tier).alias("tier"), "n")


def newest_per_group(df: DataFrame, pins: DataFrame, snapshot: str = values.SNAPSHOT) -> DataFrame:
    """The newest of df(tier, name, created, version) per tier, by date if all rows are dated, else by version, against
    pins(tier, name). A snapshot of a name is the same thing as the name. An upgrade is something else that is strictly newer,
    by date if both have one, else by version; where the pin isn't listed in any form, that is noted and the newest replaces it."""
    plain = lambda c: F.regexp_replace(c, snapshot, "")
    fact = F.struct("name", "created", "version")
    per = df.groupBy("tier").agg(F.every(F.col("created").isNotNull()).alias("dated"), F.max_by(fact, F.struct("created", "version", "name")).alias("by_date"), F.max_by(fact, F.struct("version", "name")).alias("by_version"))
    per = per.withColumn("new", F.when(F.col("dated"), F.col("by_date")).otherwise(F.col("by_version")))
    wanted = pins.select(F.col("tier"), F.col("name").alias("pin"), plain("name").alias("plain"))
    forms = df.select("tier", plain("name").alias("plain"), fact.alias("fact")).join(wanted, ["tier", "plain"])
    held = forms.groupBy("tier").agg(F.min_by("fact", F.struct(F.col("fact.name") != F.col("pin"), "fact.name")).alias("old"))
    rows = per.join(wanted, "tier", "left").join(held, "tier", "left")
    dates = F.col("new.created").isNotNull() & F.col("old.created").isNotNull()
    newer = F.col("old").isNull() | F.when(dates, F.col("new.created") > F.col("old.created")).otherwise(F.col("new.version") > F.col("old.version"))
    upgrade = F.col("pin").isNotNull() & (plain("new.name") != F.col("plain")) & newer
    return rows.select("tier", F.col("new.name").alias("newest"), "pin", F.coalesce(upgrade, F.lit(False)).alias("upgrade"), (F.col("pin").isNotNull() & F.col("old").isNull()).alias("pin_missing"))


def silent_failures(steps: DataFrame, jobs: DataFrame, reporting: tuple[str, ...] = values.REPORTING_HINTS) -> DataFrame:
    """Failed jobs(job) whose steps(job, pos, name, conclusion) after the first failure all did not run, or are
    reporting steps (by a part of the name) that failed. Bookkeeping steps and the clean-up `Post X` of an earlier step X
    don't count. A failed job without steps, or without a failed one, is silent too."""
    listed = steps.groupBy("job").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("name", F.lit("")).alias("name"), "conclusion"))).alias("s"))
    rows = jobs.where("conclusion = 'failure'").select("job").distinct().join(listed, "job", "left")
    rows = rows.withColumn("s", F.filter("s", lambda x: ~x["name"].isin(*values.BOOKKEEPING)))
    cleans = lambda x, i: x["name"].startswith("Post ") & F.array_contains(F.transform(F.slice("s", F.lit(1), i), lambda y: y["name"]), F.substring(x["name"], F.lit(6), F.length(x["name"])))
    rows = rows.withColumn("s", F.filter("s", lambda x, i: ~cleans(x, i)))
    first = F.coalesce(F.array_position(F.transform("s", lambda x: x["conclusion"]), "failure"), F.lit(0)).cast("int")
    rows = rows.withColumn("first", first)
    after = F.slice("s", F.col("first") + 1, F.greatest(F.size("s") - F.col("first"), F.lit(0)))
    quiet = F.forall(after, lambda x: x["conclusion"].isNull() | x["conclusion"].isin(*values.DID_NOT_RUN) | (F.lower(x["name"]).rlike("|".join(reporting)) & (x["conclusion"] == "failure")))
    return rows.select("job", (F.col("s").isNull() | (F.col("first") == 0) | quiet).alias("silent"))


def evaluate_coverage(golden: DataFrame, attempts: DataFrame, tries: int) -> tuple[DataFrame, DataFrame]:
    """attempts(item, attempt, tags, errored) against golden(item, expected): the union of tags over the first
    `tries` attempts, cut after the attempt that completes the coverage, must hold the expected tags; an errored one
    among them makes the item inconclusive, no attempt uncached; the summary fails closed."""
    wanted = golden.select("item", "expected")
    rows = attempts.withColumn("n", F.row_number().over(Window.partitionBy("item").orderBy("attempt"))).where(F.col("n") <= tries).join(wanted, "item")
    upto = Window.partitionBy("item").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("so_far", F.array_distinct(F.flatten(F.collect_list("tags").over(upto))))
    rows = rows.withColumn("covered", F.size(F.array_except("expected", "so_far")) == 0)
    before = Window.partitionBy("item").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("enough", F.coalesce(F.max("covered").over(before), F.lit(False))).where("not enough")
    per = rows.groupBy("item").agg(F.max("errored").alias("errored"), F.max("covered").alias("covered"), F.count("*").alias("used"))
    out = wanted.select("item").join(per, "item", "left")
    outcome = F.when(F.col("used").isNull(), "uncached").when(F.col("errored"), "inconclusive").when(F.col("covered"), "ok").otherwise("missing")
    out = out.withColumn("outcome", outcome).select("item", "outcome", F.coalesce("used", F.lit(0)).cast("long").alias("used"))
    one = out.agg(*(F.count_if(F.col("outcome") == x).alias(x) for x in ("ok", "missing", "inconclusive", "uncached")))
    return out, one.withColumn("passed", (F.col("ok") > 0) & (F.col("missing") + F.col("inconclusive") + F.col("uncached") == 0))


def invert_references(extracted: DataFrame, additions: DataFrame, drops: DataFrame) -> DataFrame:
    """(authority, dependants) from pairs(authority, dependant): extracted, plus curated additions, minus curated drops. An empty result is an error."""
    pairs = extracted.select("authority", "dependant").unionByName(additions.select("authority", "dependant")).distinct().join(drops, ["authority", "dependant"], "left_anti")
    index = pairs.groupBy("authority").agg(F.array_sort(F.collect_set("dependant")).alias("dependants"))
    if index.isEmpty():
        raise ValueError("no references were found")
    return index


def seed_mark(items: DataFrame, log: DataFrame, source: str, seed: int) -> DataFrame:
    """The first high-water mark of a source: its largest known id over items and log, else the seed."""
    both = items.select("source", "item_id").unionByName(log.select("source", "item_id"))
    return both.where(F.col("source") == source).agg(F.coalesce(F.max("item_id"), F.lit(seed)).alias("mark"))


def completeness_scan(items: DataFrame, required: list[str], arrays: list[str], date: str) -> DataFrame:
    """(item_id, problem): missing required fields; where none is missing, empty arrays and an unreadable date."""
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    missing = F.filter(F.array(*(F.when(blank(c), F.lit(f"missing {c}")) for c in required)), lambda x: x.isNotNull())
    other = F.filter(F.array(*(F.when(F.size(F.coalesce(c, F.array().cast(items.schema[c].dataType))) == 0, F.lit(f"empty {c}")) for c in arrays), F.when(F.try_to_date(F.col(date).cast("string"), "yyyy-MM-dd").isNull(), F.lit(f"bad {date}"))), lambda x: x.isNotNull())
    return items.select("item_id", F.explode(F.when(F.size(missing) > 0, missing).otherwise(other)).alias("problem"))
