"""Composite jobs. Verdicts are a table; every drop is a row with its tier."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwatch.functions import values
from docwatch.functions.text import fingerprint_pages, html_to_text, lint_reasons, readable, stable_keys
from docwatch.operators import match as M
from docwatch.operators.classify import Classifier, classified
from docwatch.operators import select as S
from docwatch.operators import state as G
from docwatch.operators import stats as E
from docwatch.sources.feeds import flatten_master_list


@dataclass(frozen=True)
class Funnel:
    kept: DataFrame
    drops: DataFrame
    floored: DataFrame


@dataclass(frozen=True)
class FunnelRun:
    cards: DataFrame  # item_id, source, flags, a column per guard, reasons, lane
    drops: DataFrame  # item_id, source, tier, reason, smell, smell_outcome
    floored: DataFrame  # source, floored
    seen: DataFrame  # item_id
    record: DataFrame  # one row
    smells: DataFrame  # item_id, smell, smell_outcome of what the suspect pass judged
    memos: dict[str, DataFrame] = field(default_factory=dict)  # by tier, of its classifier: fingerprint, passes, reason to add


Tier = tuple[str, DataFrame | Classifier]


def judged(chosen: DataFrame, tiers: list[Tier], curated: DataFrame | None, gate: Column, inputs: DataFrame | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Chosen candidates with the tier that drops each (null: none does) and the reason its verdict gives. Columns
    tier and reason are replaced. A tier's classifier sees only what reached it, with its columns of inputs (item_id, ...);
    also gives what each classifier's memo gains."""
    rows = chosen.withColumn("tier", F.when(~gate, F.lit("text"))).withColumn("reason", F.lit(None).cast("string"))
    memos = {}
    for k, (name, verdicts) in enumerate(tiers):
        if isinstance(verdicts, Classifier):
            rows = M.checkpointed(rows)
            reached = rows.where("tier is null").select("item_id")
            verdicts, memos[name] = classified(inputs.join(reached, "item_id", "left_semi"), verdicts)
        why = F.col("reason") if "reason" in verdicts.columns else F.lit(name)
        rows = rows.join(verdicts.select("item_id", F.col("passes").alias("__p"), why.alias("__why")), "item_id", "left")
        if k == 0 and curated is not None:
            rescued = M.party_match(rows.where("tier is null and not __p"), curated).select("item_id", F.lit(True).alias("__r"))
            rows = rows.join(rescued, "item_id", "left").withColumn("__p", F.col("__p") | F.coalesce("__r", F.lit(False))).drop("__r")
        lost = F.when(F.col("__p").isNull(), F.lit(f"{name}: retry")).when(~F.col("__p"), F.lit(name))
        here = F.col("tier").isNull() & F.coalesce(~F.col("__p"), F.lit(False))
        rows = rows.withColumn("reason", F.when(here, F.col("__why")).otherwise(F.col("reason")))
        rows = rows.withColumn("tier", F.coalesce("tier", lost)).drop("__p", "__why")
    return rows, memos


def funnel(candidates: DataFrame, known: list[DataFrame], since, today, exempt: list[str], tiers: list[Tier], curated: DataFrame | None = None) -> Funnel:
    """J1, its first half: candidates(item_id, source, date, ingest_seq, text) through selection, the text gate and the
    tiers, cheapest first.

    A tier is (name, verdicts(item_id, passes, reason?)) or (name, Classifier); a missing verdict is retried later and logged as such.
    curated(item_id, party_tokens) overrides the first tier's drop where candidates carry party_tokens that match."""
    chosen, floored = S.select_candidates(candidates, known, since, today, exempt)
    rows, _ = judged(chosen, tiers, curated, readable("text"), candidates)
    return Funnel(rows.where("tier is null").drop("tier", "reason"), rows.where("tier is not null").select("item_id", "source", "tier"), floored)


def funnel_run(
    candidates: DataFrame, known: list[DataFrame], existing: DataFrame, since, today, exempt: list[str], tiers: list[Tier], *,
    smells: DataFrame, validity: dict[str, Column], guards: dict[str, DataFrame], overruling: DataFrame, cleared: DataFrame, seen: DataFrame, reads: DataFrame | None = None, smell_tier: str | None = None, tries: int = 3, smell_cap: int = 5, seen_cap: int = 5_000,
) -> FunnelRun:
    """A whole run, from candidates to the two lanes and the next seen state.

    candidates and existing carry item_id, source, date, docket_tokens and party_tokens; candidates also ingest_seq and
    text. In order: selection (C1), twins of existing items, the text gate (A9), the tiers with the override by existing
    items (D4), twins within the run (D2: by ingest_seq, an item that does not pass shadows nobody), suspect drops of one tier (the last,
    if smell_tier names none), up to smell_cap of them (C10: smells(item_id, verdict)), validity flags (C15), the guards'
    consensus over guards[name](item, attempt, vote, reason) (E10; an item without attempts was not guarded and isn't
    held for that), routing (G11; overruling(item_id) holds, cleared(item_id) lifts), the seen ids (G13: what has a
    definite outcome, is not held and has a text; a missing verdict comes again) and the run's record (E5).

    A suspect drop gets a smell_outcome: `capped`; `twin` of a case that passed or of an earlier suspect; `carded` or `drop-stands` as its full
    read in reads(item_id, passes) says; `deferred` where there is no read, which C11 selects again. Without a table of
    reads every suspect under the cap is read and passes. Only `carded` ones lose their drop row."""
    slim = candidates.select("item_id", "source", "date", "ingest_seq", "docket_tokens", "party_tokens", S.reasons(**validity).alias("flags"), readable("text").alias("readable"))
    chosen, floored = S.select_candidates(slim, known, since, today, exempt)  # no text crosses a shuffle
    twins = M.same_item_keys(chosen).join(M.same_item_keys(existing).select("key"), "key", "left_semi").select("item_id", F.lit(True).alias("__twin")).distinct()
    rows, memos = judged(chosen, tiers, existing, F.col("readable"), candidates)
    rows = rows.join(twins, "item_id", "left")
    rows = rows.withColumn("tier", F.when(F.col("__twin"), F.lit("duplicate")).otherwise(F.col("tier")))
    rows = rows.withColumn("reason", F.when(F.col("__twin").isNull(), F.col("reason")))
    rows = M.checkpointed(rows.select("item_id", "source", "date", "ingest_seq", "docket_tokens", "party_tokens", "flags", "tier", "reason"))

    judged_out = rows.where(F.col("tier") == (smell_tier or tiers[-1][0])).select("item_id", "reason", F.struct("ingest_seq", "item_id").alias("seq"))
    smelled = M.checkpointed(rows.join(S.escalate_suspects(judged_out, smells, smell_cap).select("item_id", "smell"), "item_id", "left"))
    passing, suspects = smelled.where("tier is null"), smelled.where("smell = 'suspect'")  # smell_cap suspects at most
    firsts = M.checkpointed(M.dedup_greedy(passing, M.same_item_keys(passing), "ingest_seq").select("item_id"))
    taken = M.same_item_keys(passing.join(firsts, "item_id", "left_semi")).select("key")
    free = suspects.join(M.same_item_keys(suspects).join(taken, "key", "left_semi").select("item_id"), "item_id", "left_anti")
    free = M.checkpointed(free)
    read = M.dedup_greedy(free, M.same_item_keys(free), "ingest_seq").select("item_id")
    said = F.lit(True) if reads is None else F.col("__passes")
    read = read if reads is None else read.join(reads.select("item_id", F.col("passes").alias("__passes")), "item_id", "left")
    read = read.select("item_id", F.when(said, "carded").when(~said, "drop-stands").otherwise("deferred").alias("__read"))

    fate = smelled.join(firsts.withColumn("__first", F.lit(True)), "item_id", "left").join(read, "item_id", "left")
    outcome = F.when(F.col("smell") == "suspect", F.coalesce("__read", F.lit("twin"))).when(F.col("smell") == "capped", "capped")
    fate = fate.withColumn("smell_outcome", outcome).withColumn("smell", F.when(F.col("smell") == "capped", "suspect").otherwise(F.col("smell")))
    carded = F.col("__first") | F.coalesce(F.col("__read") == "carded", F.lit(False))
    fate = M.checkpointed(fate.withColumn("tier", F.when(carded, F.lit(None)).when(F.col("tier").isNull(), F.lit("duplicate")).otherwise(F.col("tier"))))

    cards = fate.where("tier is null").select("item_id", "source", "flags")
    holds = {"flags": F.size("flags") > 0, "overrules": F.col("__over").isNotNull()}
    for name, attempts in guards.items():
        own = attempts.join(cards.select(F.col("item_id").alias("item")), "item", "left_semi")
        cards = cards.join(E.consensus(own, tries).select(F.col("item").alias("item_id"), F.col("outcome").alias(name)), "item_id", "left")
        holds |= {name: F.col(name) == "flag", f"{name} unavailable": F.col(name) == "unavailable"}
    cards = cards.join(overruling.select("item_id", F.lit(True).alias("__over")).distinct(), "item_id", "left")
    cards = G.route(cards, cleared, **holds).drop("__over")

    drops = fate.where("tier is not null")
    definite = drops.where(F.col("tier").isin(["duplicate", *(name for name, _ in tiers)])).select("item_id")
    auto, held = (cards.where(F.col("lane") == lane).select("item_id") for lane in ("auto", "held"))
    after = G.advance_seen(seen_cap, held, seen.select("item_id"), definite, existing.select("item_id"), auto)
    record = E.run_record(fate.select(F.coalesce("tier", F.lit("carded")).alias("tier"), F.col("tier").isNotNull().alias("dropped")), floored)
    return FunnelRun(cards, drops.select("item_id", "source", "tier", "reason", "smell", "smell_outcome"), floored, after, record, fate.where("smell is not null").select("item_id", "smell", "smell_outcome"), memos)


def funnel_counts(f: Funnel | FunnelRun) -> DataFrame:
    """Rows per source and stage: carded ones (of a whole run by lane), each tier's drops (with their smell and its
    outcome, where they have them), and the floored ones."""
    whole = isinstance(f, FunnelRun)
    kept = f.cards.select("source", F.col("lane").alias("stage")) if whole else f.kept.select("source", F.lit("carded").alias("stage"))
    drops = f.drops.select("source", F.concat_ws(": ", "tier", "smell", "smell_outcome") if whole else F.col("tier"))
    return kept.union(drops).groupBy("source", "stage").agg(F.count("*").alias("n")).union(f.floored.select("source", F.lit("floored"), F.col("floored").alias("n")))


def treatment_sweep(items: DataFrame, edges: DataFrame, docs: DataFrame, seen: DataFrame, pending: DataFrame, verdicts: DataFrame, as_of, stopped: bool, adverse: list[str], **caps) -> dict[str, DataFrame]:
    """One sweep: the run's pairs, their windows, verdicts(item_id, citer_id, kind, affects) applied, and the next
    pending and sweep states. A pair without text waits for it; one without a verdict failed. Every visited item, also one
    without fresh citers, is swept in full unless the run stopped or a cap cut its fresh citers."""
    run = M.reverse_sweep(items, edges, seen, pending, as_of, **caps)
    windows = M.citation_windows(run.select("item_id", "citer_id"), docs, items)
    judged = run.join(windows.select("item_id", "citer_id"), ["item_id", "citer_id"], "left_semi").join(verdicts, ["item_id", "citer_id"])
    flagged, new = G.raise_flags(items, seen, judged.withColumn("date", F.coalesce("ts", F.lit(as_of).cast("date"))), adverse)
    no_text = run.join(windows.select("item_id", "citer_id"), ["item_id", "citer_id"], "left_anti")
    waits = G.retry_pending(pending, run, judged, no_text, stopped, as_of)
    total = M.sweep_citers(items, edges, seen, as_of, scope=caps.get("scope")).groupBy("item_id").agg(F.count("*").alias("all"))
    taken = run.where("not is_pending").groupBy("item_id").agg(F.count("*").alias("n"))
    seen_now = M.visited(items, caps.get("first_per_run", 3)).select("item_id")
    state = seen_now.join(total, "item_id", "left").join(taken, "item_id", "left").select("item_id", F.lit(stopped).alias("stopped"), (F.coalesce("n", F.lit(0)) < F.coalesce("all", F.lit(0))).alias("truncated"))
    return {"run": run, "windows": windows, "items": flagged, "treatments": new, "pending": waits, "sweep": G.sweep_state(items.select("item_id", F.col("full_at").isNotNull().alias("full")), state)}


def page_watch(pages: DataFrame, state: DataFrame, existing: DataFrame, required: str, any_of: list[str]) -> dict[str, DataFrame]:
    """pages(url, html, title) to text, hash and shell gate; changed pages become watch items merged by their stable key."""
    read = html_to_text(pages, "html")
    hashed = fingerprint_pages(read, "page_text", required, any_of).withColumnRenamed("content_hash", "hash").withColumn("extracted", F.length("page_text") > 0)
    outcome, next_state = G.detect_page_changes(hashed, state)
    changed = stable_keys(pages.join(outcome.where("outcome = 'changed'").select("url"), "url", "left_semi"), "title")
    new = changed.select("stable_key", "canonical", "url", F.lit(None).cast("date").alias("first_seen"))
    return {"outcome": outcome, "state": next_state, "items": G.merge_items(existing, new, "stable_key", "url")}


def registry_watch(
    lists: DataFrame, periods: DataFrame, record: str, this_year: int, seen: DataFrame, existing: DataFrame, requests: DataFrame, results: DataFrame, audits: DataFrame, logged: DataFrame, *,
    statuses: list[str], excluded_prefix: str, words: list[str], max_age: int, max_fails: int = 3,
) -> dict[str, DataFrame]:
    """lists(period_id, payload) of the active periods(period_id, last_year) (C5), flattened (A3: the DDL record names
    item_id, status, number, token and title; of a record that is listed twice the newest period's counts). Records that
    moved (C3) are screened by title words.

    Every screen drop is audited by audits(item_id, token, suspect): a suspect goes on; a drop that was confirmed is seen
    in this version; one whose audit failed (no verdict) comes again, and goes on without one after max_fails failures in
    logged(item_id, token, recall). Late results that apply (D13) are merged (G1) and settle their version."""
    live = S.active_periods(periods, "last_year", this_year, "period_id").select("period_id")
    records = flatten_master_list(lists.join(live, "period_id", "left_semi"), "payload", record, id_field="item_id", keep=("period_id",))
    moved = S.moved_records(S.first_per_key(records, "item_id", F.desc("period_id"), "token"), seen, statuses, excluded_prefix)
    version = ["item_id", "token"]
    verdicts = audits.groupBy(*version).agg(F.max("suspect").alias("suspect"))
    fails = logged.where("recall = 'error'").groupBy(*version).agg(F.count("*").alias("fails"))
    rows = moved.withColumn("wanted", F.coalesce(F.lower("title").rlike("|".join(words)), F.lit(False))).join(verdicts, version, "left").join(fails, version, "left")
    recall = F.when(F.col("suspect") | (F.col("fails") >= max_fails), "escalated").when(~F.col("suspect"), "ok").otherwise("error")
    rows = M.checkpointed(rows.select(*version, "status", "title", "wanted", F.when(~F.col("wanted"), recall).alias("recall")))

    screened = rows.where("wanted or recall = 'escalated'")
    outcome = M.apply_carried(requests, results, screened.select("item_id"), max_age)
    applied = outcome.where("outcome = 'applied'").groupBy("item_id").agg(F.max(F.col("verdict") == "keep").alias("keep"))
    new = screened.join(applied.where("keep"), "item_id", "left_semi").select("item_id", "status", "token", F.lit(None).cast("date").alias("first_seen"))
    settled = screened.join(applied, "item_id", "left_semi").select(*version).union(rows.where("recall = 'ok'").select(*version))
    drops = rows.where("not wanted").select(*version, F.lit("screen").alias("stage"), F.col("title").alias("reason"), "recall")
    after = S.without(seen.select(*version), "item_id", settled.select("item_id")).union(settled)
    return {"outcome": outcome, "items": G.merge_items(existing, new, "item_id", "token"), "drops": drops, "seen": after}


def immutable_watch(records: DataFrame, seen: DataFrame, existing: DataFrame, as_of, wanted, days: int = 45) -> DataFrame:
    """records(item_id, date, …) never seen, within the lookback and wanted (a Column), merged into the curated rows."""
    recent = records.where(F.col("date") >= F.date_sub(F.lit(as_of).cast("date"), days))
    new = S.without(recent, "item_id", seen).where(wanted)
    return G.merge_items(existing, new.select(*existing.columns), "item_id", "item_id")


def log_lint(log: DataFrame, allowed: DataFrame, vocabulary: DataFrame, hedges: str = values.HEDGES) -> DataFrame:
    """The sections hedges, quotes and categories over a whole log(key, stage, category, reason, name, docket, evidence), as (section, key, detail)."""
    hedged = lint_reasons(log, "reason", hedges).where(F.size("hedges") > 0).select(F.lit("hedges").alias("section"), "key", F.array_join("hedges", ",").alias("detail"))
    checked = M.verify_quotes(log, vocabulary).where(F.size("unsupported") > 0)
    grade = F.when(F.size("echoed") > 0, "echo").when(F.col("firm"), "firm").otherwise("provisional")
    quotes = checked.select(F.lit("quotes"), "key", F.concat_ws(":", grade, F.array_join("unsupported", "|")))
    invalid = S.closed_category_check(log, allowed).where("category_invalid").select(F.lit("categories"), "key", "category")
    return hedged.union(quotes).union(invalid)


def guard_revalidate(items: DataFrame, attempts: DataFrame, k: int, epoch_day: int, tries: int) -> tuple[DataFrame, DataFrame]:
    """The day's rotating slice of items re-checked by attempts(item, attempt, vote, reason): an outcome per item,
    where no attempt is undecided, and the counts, undecided ones apart from ok."""
    today = S.rotating_slice(items.select("item_id"), "item_id", k, epoch_day)
    voted = E.consensus(attempts.withColumnRenamed("item", "item_id").join(today, "item_id", "left_semi").withColumnRenamed("item_id", "item"), tries)
    rows = today.join(voted.select(F.col("item").alias("item_id"), "outcome"), "item_id", "left")
    rows = rows.withColumn("outcome", F.when(F.col("outcome") == "flag", "flagged").when(F.col("outcome") == "clear", "ok").otherwise("undecided"))
    return rows, rows.groupBy("outcome").agg(F.count("*").alias("n"))


def backfill_sweep(candidates: DataFrame, known: list[DataFrame], since, until, tiers: list[tuple[str, DataFrame]]) -> DataFrame:
    """candidates(item_id, source, name, date, docket_tokens, holdings, ingest_seq, text) of any date range, one per identity, through the tiers: rows per status and tier."""
    chosen, _ = S.select_candidates(candidates, known, since, until, [])
    unique = M.dedup_by_identity(chosen)
    f = funnel(unique, [], since, until, [], tiers)
    same = S.without(chosen, "item_id", unique.select("item_id")).select(F.lit("duplicate").alias("status"), F.lit("identity").alias("tier"))
    rows = f.kept.select(F.lit("carded").alias("status"), F.lit("all").alias("tier")).union(f.drops.select(F.lit("dropped"), "tier")).union(same)
    return E.sweep_report(rows, "status", "tier")
