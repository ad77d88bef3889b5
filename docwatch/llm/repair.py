"""Conversation structure repair: the cheapest edits that give role initials of the form (s?(ua)+)?, by one integer DP.

Edits of a conversation's rows, in order: Keep (0), Rerole to user or assistant (2), Delete (3), and Insert of an empty turn of
user or assistant anywhere (2). Blank rows and repeats of an earlier row must go; a truncated row that stays costs 1 more.
Of the cheapest sequences the one whose initials (D, I, K, R) come first in ASCII is taken.

A weight is one integer: its high digits hold the cost, below them every letter of the edits has a place of fixed width,
the first letter the highest, and places behind the last letter are zero. The smaller integer is thus the cheaper sequence
and, of equally cheap ones, the one that comes first (a prefix comes before what it begins). Going back from the end, a state
takes the least weight over its edits, each of which moves the rest's letters one place down and sets the first. States are
nothing yet, after system, after user, after assistant; in one gap two inserts are enough, since a third leads back to a state
that is reached without. A letter and a state name the role that Rerole and Insert give, so the letters are the whole answer.

A conversation of at most longest rows is repaired by the task that its id is dealt to. A longer one is cut into blocks of
consecutive rows; the inserts of a gap belong to the block of the next row. A block's least costs from state to state are
chained from the end (a few numbers a block), which gives the cost of all that follows a block; with those as goals each
block finds its letters alone. Within a block no letters are the start of others, since each has a letter per row and ends
with one, so the order is decided inside it. The longest run of work in one task is thus a chain of numbers per block.

Defined cases: a null role or text is one space; rows come by turn (nulls first), ties by role, then text; repeated rows are
repeats, which must go; a null id is a conversation of its own; a role without a first letter can't be kept; a very long
text is read where it lies; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docwatch.llm.common import cut

SPACE = " \t\n\v\f\r"
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
LETTERS = " DIKR"
FINE, TRUNCATED, GONE = 0, 1, 2
#: What the next turn is if one is made up, and the state after each initial, by state: nothing yet, after s, after u, after a.
NEXT = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: Costs of what follows the end, by state.
CLOSED = (0, None, None, 0)
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def solve(initials: list[str], faults: list[int], goal=CLOSED, last: bool = True) -> list[tuple[int, str] | None]:
    """Per state before the first row: the least cost up to goal and its letters, None where no edits lead there.
    goal: the cost of all that follows, by state; last: turns may be inserted behind the last row too."""
    width = 3 * (3 * len(initials) + 2)
    low = (1 << width) - 1

    def first(cost: int, letter: int, rest: int | None) -> int | None:
        return None if rest is None else (((rest >> width) + cost) << width) | (letter << (width - 3)) | ((rest & low) >> 3)

    def least(*weights: int | None) -> int | None:
        return min((w for w in weights if w is not None), default=None)

    def with_inserts(plain: list[int | None]) -> list[int | None]:
        one = [least(w, first(2, INSERT, plain[NEXT[s][1]])) for s, w in enumerate(plain)]
        return [least(w, first(2, INSERT, one[NEXT[s][1]])) for s, w in enumerate(plain)]

    weights = [None if g is None else g << width for g in goal]
    weights = with_inserts(weights) if last else weights
    for k in range(len(initials) - 1, -1, -1):
        plain = []
        for s in range(4):
            ways = [first(3, DELETE, weights[s])]
            if faults[k] != GONE:
                to = AFTER[s].get(initials[k])
                ways += [first(faults[k], KEEP, weights[to]) if to else None, first(2 + faults[k], REROLE, weights[NEXT[s][1]])]
            plain.append(least(*ways))
        weights = with_inserts(plain)
    return [None if w is None else (w >> width, spelled(w & low, width)) for w in weights]


def spelled(letters: int, width: int) -> str:
    digits = (letters >> k & 7 for k in range(width - 3, -1, -3))
    return "".join(LETTERS[d] for d in digits if d)


def apply(audit: str, rows: Iterator[tuple[str, str]], state: int = 0) -> tuple[list[tuple[str, str]], int]:
    """The turns (role, text) after the edits, and the state they lead to."""
    out, rows = [], iter(rows)
    for letter in audit:
        if letter == "I":
            role, state = NEXT[state]
            out.append((role, ""))
            continue
        role, text = next(rows)
        if letter == "R":
            role, state = NEXT[state]
        elif letter == "K":
            state = AFTER[state][role[0]]
        if letter != "D":
            out.append((role, text))
    return out, state


def key_of(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def fault_of(text: str, seen: bool) -> tuple[str, int]:
    """The row's first fault, and what the DP needs to know of it."""
    bare = text.strip(SPACE)
    if not bare:
        return "blank", GONE
    if seen:
        return "duplicate", GONE
    return ("", FINE) if bare[-1] in ".!?" else ("truncated", TRUNCATED)


def illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def gaps_in(turns: list[int | None]) -> int:
    there = {t for t in turns if t is not None}
    return max(there) - min(there) + 1 - len(there) if there else 0


def groups(batches, size: int = 1024):
    """(id, rows) of sorted Arrow batches, whose first column is the id."""
    now, held = None, []
    for batch in batches:
        for k in range(0, batch.num_rows, size):
            for who, *row in zip(*(c.to_pylist() for c in batch.slice(k, size).columns), strict=True):
                if held and who != now:
                    yield now, held
                    held = []
                now = who
                held.append(row)
    if held:
        yield now, held


def whole(kind: pa.DataType):
    """Repairs conversations that lie in one task: rows (id, turn, role, text), sorted."""
    schema = pa.schema([("id", kind), ("part", pa.int64()), *((c, pa.int64()) for c in (*COUNTS, "cost")), ("audit", pa.string()), ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])

    def work(batches):
        out, size = [], 0
        for who, rows in groups(batches):
            seen, counts, faults = set(), dict.fromkeys(("blank", "duplicate", "truncated", ""), 0), []
            for _, role, text in rows:
                name, fault = fault_of(text, (key := key_of(role, text)) in seen)
                seen.add(key)
                counts[name] += 1
                faults.append(fault)
            initials = [role[:1] for _, role, _ in rows]
            cost, audit = solve(initials, faults)[0]
            turns = apply(audit, ((role, text) for _, role, text in rows))[0]
            out.append({"id": who, "part": 0, "gaps": gaps_in([t for t, _, _ in rows]), "illegal": illegal(initials), "cost": cost, "audit": audit, "repaired": [{"role": r, "text": t} for r, t in turns]} | {c: counts[c] for c in ("blank", "duplicate", "truncated")})
            size += len(rows)
            if size >= 1024:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return work


#: Least cost from each state to the end where no row is left.
CLOSING = (0, 4, 2, 0)


def placed_in_blocks(longest: int):
    """Adds a number per block of at most longest consecutive rows of a conversation, and the row's place in it."""

    def work(batches):
        block, k, now, begun = (TaskContext.get().partitionId() << 40) - 1, 0, None, False
        for batch in batches:
            blocks, places = [], []
            for who in batch.column(0).to_pylist():
                if not begun or who != now or k == longest:
                    block, k, now, begun = block + 1, 0, who, True
                blocks.append(block)
                places.append(k)
                k += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks, pa.int64()), pa.array(places, pa.int64())], names=[*batch.schema.names, "block", "seq"])

    return work


def each(f, schema: pa.Schema):
    """A Python function of a row (a dict) over Arrow batches."""

    def work(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                yield pa.RecordBatch.from_pylist([f(batch.slice(k, 1).to_pylist()[0])], schema)

    return work


def costs_of(row: dict) -> dict:
    """A block's least costs from state to state, flat; -1 where no edits lead."""
    ways = []
    for end in range(4):
        goal = tuple(0 if s == end else None for s in range(4))
        ways.append([-1 if w is None else w[0] for w in solve([r["initial"] for r in row["rows"]], [r["fault"] for r in row["rows"]], goal, last=False)])
    return {"block": row["block"], "costs": [ways[e][s] for s in range(4) for e in range(4)]}


def goals_of(blocks):
    """Chains the costs of a conversation's blocks from its end: the least cost of what follows each block, by state."""
    blocks = blocks.sort_values("block", ascending=False)
    goals, after = [], CLOSING
    for costs in blocks["costs"]:
        goals.append(list(after))
        after = tuple(min(c + after[e] for e, c in enumerate(costs[4 * s : 4 * s + 4]) if c >= 0) for s in range(4))
    return blocks[["block"]].assign(goal=goals, last=[k == 0 for k in range(len(goals))], before=blocks["end"].shift(-1))


def letters_of(row: dict) -> dict:
    """A block's letters from each state, and the states they lead to."""
    initials, faults = [r["initial"] for r in row["rows"]], [r["fault"] for r in row["rows"]]
    found = solve(initials, faults, CLOSED if row["last"] else tuple(row["goal"]), row["last"])
    ends = [apply(audit, ((i, "") for i in initials), s)[1] for s, (_, audit) in enumerate(found)]
    return {"block": row["block"], "audits": [audit for _, audit in found], "ends": ends, "illegal": illegal(([row["before"]] if row["before"] is not None else []) + initials)}


def states_of(blocks):
    """Chains the states from a conversation's start."""
    blocks, states = blocks.sort_values("block"), [0]
    for ends in blocks["ends"]:
        states.append(int(ends[states[-1]]))
    return blocks[["block"]].assign(state=states[:-1])


def edited(row: dict) -> dict:
    rows = sorted(row["texts"], key=lambda r: r["seq"])
    turns = apply(row["audit"], ((r["role"], r["text"]) for r in rows), row["state"])[0]
    kept = zip((x for x in row["audit"] if x != "I"), (r["fault"] for r in rows), strict=True)
    cost = 2 * row["audit"].count("I") + sum(3 if x == "D" else f + 2 * (x == "R") for x, f in kept)
    return {"part": row["block"], "cost": cost, "repaired": [{"role": r, "text": t} for r, t in turns]} | {c: row[c] for c in ("id", *COUNTS, "audit")}


def in_blocks(rows: DataFrame, longest: int) -> DataFrame:
    """Repairs conversations of any length: rows (id, turn, role, text)."""
    id_type = rows.schema["id"].dataType.simpleString()
    order = [F.col("id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    schema = f"id {id_type}, turn bigint, role string, text string, block bigint, seq bigint"
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(placed_in_blocks(longest), schema))
    key = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    keyed = placed.select("id", "turn", "block", "seq", F.substring("role", 1, 1).alias("initial"), key.alias("key"), (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("bare"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("open"))
    first = cut(keyed.groupBy(F.col("id").alias("of"), F.col("key").alias("same")).agg(F.min(F.struct("block", "seq")).alias("first")))
    seen = keyed.join(first, keyed["id"].eqNullSafe(first["of"]) & (keyed["key"] == first["same"]))
    name = F.when(F.col("bare"), "blank").when(F.struct("block", "seq") != F.col("first"), "duplicate").when(F.col("open"), "truncated").otherwise("")
    light = seen.select("id", "block", "seq", "turn", "initial", name.alias("name")).withColumn("fault", F.when(F.col("name") == "truncated", TRUNCATED).when(F.col("name") == "", FINE).otherwise(GONE))
    count = lambda c: F.count_if(F.col("name") == c).alias(c)
    blocks = cut(light.groupBy("id", "block").agg(F.sort_array(F.collect_list(F.struct("seq", "initial", "fault"))).alias("rows"), *map(count, ("blank", "duplicate", "truncated"))))
    costs = blocks.select("block", "rows").mapInArrow(each(costs_of, pa.schema([("block", pa.int64()), ("costs", pa.list_(pa.int32()))])), "block bigint, costs array<int>")
    ends = blocks.select("id", F.col("block").alias("b"), F.element_at("rows.initial", -1).alias("end"))
    goals = costs.join(ends, costs["block"] == ends["b"]).groupBy("id").applyInPandas(goals_of, "block bigint, goal array<int>, last boolean, before string")
    kinds = pa.schema([("block", pa.int64()), ("audits", pa.list_(pa.string())), ("ends", pa.list_(pa.int32())), ("illegal", pa.int64())])
    solved = cut(blocks.select("block", "rows").join(goals, "block").mapInArrow(each(letters_of, kinds), "block bigint, audits array<string>, ends array<int>, illegal bigint"))
    states = blocks.select("id", "block").join(solved, "block").select("id", "block", "ends").groupBy("id").applyInPandas(states_of, "block bigint, state int")
    gap = F.coalesce(F.max("turn") - F.min("turn") + 1, F.lit(0)) - F.count_distinct("turn")
    gaps = light.groupBy("id").agg(gap.alias("gaps"), F.min("block").alias("block")).select("block", "gaps")
    texts = placed.join(light.select(F.col("block").alias("b"), F.col("seq").alias("s"), "fault"), (F.col("block") == F.col("b")) & (F.col("seq") == F.col("s"))).groupBy("block").agg(F.collect_list(F.struct("seq", "role", "text", "fault")).alias("texts"))
    all_ = blocks.drop("rows").join(solved, "block").join(states, "block").join(gaps, "block", "left").join(texts, "block")
    all_ = all_.select("id", "block", "state", F.get("audits", "state").alias("audit"), F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "texts")
    arrow = pa.schema([("id", pa.int64()), ("part", pa.int64()), *((c, pa.int64()) for c in (*COUNTS, "cost")), ("audit", pa.string()), ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])
    return all_.mapInArrow(each(edited, arrow), f"id bigint, part bigint, {', '.join(f'{c} bigint' for c in (*COUNTS, 'cost'))}, audit string, repaired array<struct<role:string,text:string>>")


def repair(rows: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", longest: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """The conversations of at most longest rows, and the longer ones in parts: (id, part, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired). A longer one's counts and costs are sums over its parts; audit and repaired turns follow in
    order of part."""
    given = rows.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{turn}`").cast("long").alias("turn"), *(F.coalesce(F.col(f"`{c}`"), F.lit(" ")).alias(a) for c, a in ((role, "role"), (text, "text"))))
    long = given.groupBy(F.col("id").alias("of")).count().where(F.col("count") > longest)
    same = given["id"].eqNullSafe(long["of"])
    few = given.join(long, same, "left_anti").repartition("id").sortWithinPartitions(F.col("id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    schema = f"id bigint, part bigint, {', '.join(f'{c} bigint' for c in (*COUNTS, 'cost'))}, audit string, repaired array<struct<role:string,text:string>>"
    return few.mapInArrow(whole(pa.int64()), schema), in_blocks(given.join(long, same, "left_semi"), longest)
