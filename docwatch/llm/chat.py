"""Chat formatting: records of many layouts become canonical turns, and turns become marked text with a loss mask.

A record's fingerprint is the XXH64 of its nested field paths, one a line in order: `prompt`, `messages[].role`, ... A path
counts where the record has a value there; only top-level names that some layout uses count, other columns are ignored.
The fingerprint selects a declarative mapping (`Layout`), or none: such records are listed by `unknown`, never guessed at.
Mapping and formatting of turns are column expressions.

Every turn is `<|im_start|>role`, a line feed, the text, `<|im_end|>` and a line feed. A control string in a text or role gets
a mark (U+2060) after its first character, one that already has marks there gets one more, so taking one away restores the
text; in roles backslash and line feed are escaped too. No control string contains the start of another, so marks can't
meet. The loss mask spans each assistant text, without header and end mark.

Turns are dealt by ranges of (id, seq, role, text), so a conversation of any size is spread over tasks; each task writes
its conversations in parts of at most part_chars characters and one turn, in order. `read_back` streams a
conversation's parts in order and holds one part at a time; the digest of a conversation is one sequence by its nature.

Defined cases: a null text is empty, so is a null role; turns come by seq (nulls first), ties by role, then text; repeated rows
are turns of their own; a null id is a conversation of its own; a record with an empty list of messages has no turns and
gives no conversation; a very long text is one part; an empty table gives an empty result; other columns are ignored unless
they bear a name that a layout uses.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import combinations
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType


MARK = "\u2060"
#: Control strings of common templates, by their first character: fixed values.
CONTROL = {"<": ["|im_start|>", "|im_end|>", "|endoftext|>", "|eot_id|>", "|start_header_id|>", "|end_header_id|>", "s>", "/s>", "<SYS>>", "</SYS>>"], "[": ["INST]", "/INST]"]}


class Layout(NamedTuple):
    """many: a list of messages with the fields role and text; turns: (role, columns) each, joined by a blank line where there are
    several; else a record is one turn, numbered by order. names: its role names that are others here. optional: paths that may lack."""

    name: str
    many: str = ""
    role: str = ""
    text: str = ""
    order: str = ""
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    names: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()

    def paths(self) -> set[str]:
        if self.turns:
            return {c for _, columns in self.turns for c in columns}
        return {f"{self.many}[].{f}" for f in (self.role, self.text)} if self.many else {self.order, self.role, self.text}


LAYOUTS = (
    Layout("messages", many="messages", role="role", text="content", optional=("messages[].content",)),
    Layout("from_value", many="conversations", role="from", text="value", names=(("human", "user"), ("gpt", "assistant")), optional=("conversations[].value",)),
    Layout("prompt", turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), optional=("system",)),
    Layout("instruction", turns=(("user", ("instruction", "input")), ("assistant", ("output",))), optional=("input",)),
    Layout("turn", role="role", text="text", order="turn", optional=("turn", "text")),
)


def digest_of(paths) -> int:
    """As xxhash64() of the joined paths in Spark."""
    x = xxhash.xxh64_intdigest("\n".join(sorted(paths)).encode(), seed=42)
    return x - (1 << 64) if x >> 63 else x


def registry(layouts: tuple[Layout, ...]) -> dict[int, int]:
    """Fingerprint to the layout's place. Two layouts with the same paths are an error."""
    out: dict[int, int] = {}
    for k, layout in enumerate(layouts):
        for n in range(len(layout.optional) + 1):
            for missing in combinations(layout.optional, n):
                key = digest_of(layout.paths() - set(missing))
                if out.setdefault(key, k) != k:
                    raise ValueError(f"{layout.name} and {layouts[out[key]].name} have the same paths")
    return out


def leaves(kind: DataType, path: str) -> Iterator[tuple[str, Callable[[Column], Column]]]:
    """The leaf paths of a column, each with the test whether a value has it."""

    def of_field(name: str, has: Callable) -> Callable[[Column], Column]:
        return lambda c: has(c.getField(name))

    def of_any(has: Callable) -> Callable[[Column], Column]:
        return lambda c: F.coalesce(F.exists(c, lambda x: has(x)), F.lit(False))

    if isinstance(kind, StructType):
        for f in kind.fields:
            yield from ((p, of_field(f.name, has)) for p, has in leaves(f.dataType, f"{path}.{f.name}"))
    elif isinstance(kind, ArrayType):
        yield from ((p, of_any(has)) for p, has in leaves(kind.elementType, f"{path}[]"))
    else:
        yield path, lambda c: c.isNotNull()


def field_paths(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """ARRAY<STRING>: a record's paths, in order."""
    used = {re.split(r"[.\[]", p)[0] for layout in layouts for p in layout.paths()}
    found = [(p, has(F.col(f"`{f.name}`"))) for f in records.schema.fields if f.name in used for p, has in leaves(f.dataType, f.name)]
    return F.filter(F.array(*(F.when(has, F.lit(p)) for p, has in sorted(found, key=lambda x: x[0]))), lambda p: p.isNotNull()) if found else F.array().cast("array<string>")


def fingerprinted(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """records with __paths, __fingerprint and __layout (the layout's place, null where none fits)."""
    known = F.create_map(*(F.lit(x) for pair in registry(layouts).items() for x in pair))
    rows = records.withColumn("__paths", field_paths(records, layouts))
    rows = rows.withColumn("__fingerprint", F.xxhash64(F.array_join("__paths", "\n")))
    return rows.withColumn("__layout", known[F.col("__fingerprint")])


def unknown(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(fingerprint, paths, records): the layouts that no mapping covers."""
    return fingerprinted(records, layouts).where("__layout IS NULL").groupBy(F.col("__fingerprint").alias("fingerprint"), F.col("__paths").alias("paths")).agg(F.count("*").alias("records"))


def canonical(records: DataFrame, id: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(id, layout, seq, role, text): the turns of all records that a layout covers."""
    have = set(records.columns)
    text = lambda c: F.coalesce(c, F.lit(""))

    def role(layout: Layout, c: Column) -> Column:
        return F.coalesce(F.create_map(*(F.lit(x) for pair in layout.names for x in pair))[c], text(c)) if layout.names else text(c)

    def turns(layout: Layout) -> Column:
        turn = lambda seq, who, said: F.struct(seq.cast("long").alias("seq"), who.alias("role"), said.alias("text"))
        if layout.many:
            return F.transform(f"`{layout.many}`", lambda m, k: turn(k, role(layout, m.getField(layout.role)), text(m.getField(layout.text))))
        if layout.turns:
            there = lambda columns: [F.col(f"`{c}`") for c in columns if c in have]
            some = lambda columns: F.filter(F.array(*there(columns)), lambda c: c.isNotNull())
            all_ = F.array(*(F.when(F.size(some(columns)) > 0, turn(F.lit(k), F.lit(who), F.array_join(some(columns), "\n\n"))) for k, (who, columns) in enumerate(layout.turns) if there(columns)))
            return F.filter(all_, lambda t: t.isNotNull())
        order = F.col(f"`{layout.order}`") if layout.order in have else F.lit(None)
        return F.array(turn(order, role(layout, F.col(f"`{layout.role}`")), text(F.col(f"`{layout.text}`") if layout.text in have else F.lit(""))))

    rows = fingerprinted(records, layouts)
    needed = lambda x: {re.split(r"[.\[]", p)[0] for p in x.paths() - set(x.optional)}
    cases = [F.when(F.col("__layout") == k, turns(x)) for k, x in enumerate(layouts) if needed(x) <= have and (not x.many or x.many in have)]
    if not cases:
        return rows.where("false").select(F.col(f"`{id}`"), F.lit("").alias("layout"), F.lit(0).cast("long").alias("seq"), F.lit("").alias("role"), F.lit("").alias("text"))
    names = F.array(*(F.lit(x.name) for x in layouts))
    rows = rows.where("__layout IS NOT NULL").select(F.col(f"`{id}`").alias("id"), F.get(names, F.col("__layout")).alias("layout"), F.explode(F.coalesce(*cases)).alias("t"))
    return rows.select(F.col("id").alias(id), "layout", "t.seq", "t.role", "t.text")


def pattern(after: str, before: str = "") -> str:
    """At each control string: after its first character, with any marks that it has."""
    either = lambda rest: "|".join(map(re.escape, rest))
    return "|".join(f"{before.format(re.escape(c))}{after}(?={MARK}*(?:{either(rest)}))" if before else f"{re.escape(c)}(?={MARK}*(?:{either(rest)}))" for c, rest in CONTROL.items())


PLAIN, MARKED = pattern(""), re.compile(pattern(MARK, "(?<={})"))
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(PLAIN), F.lit("$0" + MARK))


def unescaped(text: str) -> str:
    return MARKED.sub("", text)


def unescaped_role(role: str) -> str:
    return unescaped(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


def streamed(batches, size: int):
    """The rows of Arrow batches, a few at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, size):
            yield from zip(*(c.to_pylist() for c in batch.slice(k, size).columns), strict=True)


def format_turns(turns: DataFrame, id: str, part_chars: int = 1 << 22) -> DataFrame:
    """(id, part, text, loss): a conversation's marked text, in order of part, and the spans of each part that count for the
    loss (code points, end exclusive). Conversations have one part but where they are long or a range of rows ends in them."""
    line = lambda role: F.replace(F.replace(escaped(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    rows = turns.select(F.col(f"`{id}`").alias("id"), F.col("seq").cast("long").alias("seq"), *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")))
    order = [F.col("id").asc_nulls_first(), F.col("seq").asc_nulls_first(), "role", "text"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select("id", (F.col("role") == "assistant").alias("counts"), F.concat(F.lit("<|im_start|>"), line(F.col("role")), F.lit("\n")).alias("head"), escaped(F.col("text")).alias("body"))

    def work(batches):
        base, k = TaskContext.get().partitionId() << 32, 0
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        now, pieces, loss, at = None, [], [], 0

        def part():
            return pa.RecordBatch.from_arrays([pa.array([now], ids), pa.array([base + k]), pa.array(["".join(pieces)]), pa.array([loss], kind)], names=["id", "part", "text", "loss"])

        for batch in batches:
            ids, done = batch.schema.field(0).type, []
            for who, counts, head, body in streamed([batch], 1024):
                if pieces and (who != now or at + len(head) + len(body) > part_chars):
                    done.append(part())
                    k, pieces, loss, at = k + 1, [], [], 0
                now = who
                pieces += (head, body, "<|im_end|>\n")
                if counts:
                    loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
                at += len(head) + len(body) + len("<|im_end|>\n")
            yield from done
        if pieces:
            yield part()

    return rows.mapInArrow(work, f"id {rows.schema['id'].dataType.simpleString()}, part bigint, text string, loss array<struct<start:bigint,end:bigint>>").withColumnRenamed("id", id)


def parsed(text: str) -> list[tuple[str, str]]:
    """The turns of a marked text."""
    out, at = [], 0
    for m in TURN.finditer(text):
        if m.start() != at:
            break
        out.append((unescaped_role(m[1]), unescaped(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError(f"no turn at character {at}")
    return out


def read_back(formatted: DataFrame, id: str) -> DataFrame:
    """What a reader of the output finds: (id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)."""
    rows = formatted.select(F.col(f"`{id}`").alias("id"), "part", "text", "loss").repartition("id").sortWithinPartitions(F.col("id").asc_nulls_first(), "part")

    def work(batches):
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        now, held = None, None

        def row(ids):
            turns, loss = held[1].hexdigest(), held[3].hexdigest()
            return pa.RecordBatch.from_arrays([pa.array([now], ids), *(pa.array([v], t) for v, t in zip((held[0], turns, held[2], loss, held[4]), kinds, strict=True))], names=["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            ids, done = batch.schema.field(0).type, []
            for who, _, text, loss in streamed([batch], 16):
                if held and who != now:
                    done.append(row(ids))
                    held = None
                now, held = who, held or [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parsed(text):
                    held[0] += 1
                    held[1].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    said = unescaped(text[span["start"] : span["end"]])
                    held[2] += len(said)
                    held[3].update(said.encode())
                held[4] += len(text)
            yield from done
        if held:
            yield row(ids)

    return rows.mapInArrow(work, f"id {rows.schema['id'].dataType.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint").withColumnRenamed("id", id)


def from_turns(turns: DataFrame, id: str, longest: int = 64) -> DataFrame:
    """Records in the layouts above, one per conversation of at most longest turns, else one per turn: what a corpus put
    together from many sources looks like. turns(id, turn, role, text); which layout depends on the conversation's roles and its id."""
    rows = turns.select(F.col(f"`{id}`").alias("id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")))
    sizes = rows.groupBy(F.col("id").alias("of")).agg(F.count("*").alias("n"))
    rows = rows.join(sizes, rows["id"].eqNullSafe(sizes["of"])).drop("of")
    short = rows.where(F.col("n") <= longest).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    roles, said = F.col("m.role"), lambda k: F.get(F.col("m.text"), F.lit(k))
    shape = lambda *r: roles == F.array(*map(F.lit, r))
    common = F.size(F.array_except(roles, F.array(*map(F.lit, ("system", "user", "assistant"))))) == 0
    even = F.pmod(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")), F.lit(2)) == 0
    kind = F.when(shape("user", "assistant"), F.when(even, "prompt").otherwise("instruction")).when(shape("system", "user", "assistant"), "system").when(common & even, "from_value").otherwise("messages")
    short = short.withColumn("kind", kind)
    on = lambda kinds, value: F.when(F.col("kind").isin(*kinds), value)
    other = F.create_map(*map(F.lit, ("user", "human", "assistant", "gpt", "system", "system")))
    records = short.select(
        F.col("id"), on(["messages"], F.transform("m", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))).alias("messages"),
        on(["from_value"], F.transform("m", lambda t: F.struct(other[t["role"]].alias("from"), t["text"].alias("value")))).alias("conversations"),
        on(["system"], said(0)).alias("system"), F.when(F.col("kind") == "prompt", said(0)).when(F.col("kind") == "system", said(1)).alias("prompt"),
        F.when(F.col("kind") == "prompt", said(1)).when(F.col("kind") == "system", said(2)).alias("completion"), on(["instruction"], said(0)).alias("instruction"), on(["instruction"], said(1)).alias("output"),
    )
    return records.unionByName(rows.where(F.col("n") > longest).drop("n"), allowMissingColumns=True).withColumnRenamed("id", id)
