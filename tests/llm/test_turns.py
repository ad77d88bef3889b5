"""Periodic runs, chat formatting and conversation repair against brute force, round trips and edge cases."""

import hashlib
import heapq
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docwatch.llm import chat, periodic, queries_turns, repair


def slow_runs(words, least, times):
    best = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                best.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((i, n, q) for (i, n), q in best.items())


def periodic_words(r):
    words = [r.randrange(r.choice([1, 2, 3, 30])) for _ in range(r.randint(0, 60))]
    if words and r.random() < 0.6:
        a = r.randrange(len(words))
        p = 1 + (len(words) - a) // r.randint(2, 10)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]
    return words


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 2), (4, 3), (9, 2)])
def test_runs_against_brute_force(least, times):
    r = random.Random(least)
    for _ in range(60):
        docs = [periodic_words(r) for _ in range(20)]
        got = periodic.runs_together(np.array(sum(docs, []), dtype=np.int64), np.array([len(d) for d in docs]), least, times)
        assert [got.get(k, []) for k in range(20)] == [slow_runs(d, least, times) for d in docs]


def test_suffix_array_and_lcp():
    r = random.Random(2)
    docs = [[r.randrange(3) for _ in range(r.randint(1, 40))] for _ in range(15)]
    codes, sizes = np.array(sum(docs, [])), np.array([len(d) for d in docs])
    doc, end = np.repeat(np.arange(15), sizes), np.repeat(np.cumsum(sizes), sizes)
    order, lcp = periodic.suffixes(codes, doc, end)
    suffix = lambda i: codes[i : end[i]].tolist()
    assert order.tolist() == sorted(range(len(codes)), key=lambda i: (doc[i], suffix(i)))
    for k in range(1, len(order)):
        a, b = suffix(order[k - 1]), suffix(order[k])
        same = next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert lcp[k] == (same if doc[order[k]] == doc[order[k - 1]] else 0)


def test_runs_of_one_word_and_of_a_repeated_line():
    r = random.Random(4)
    same = [0] * 20_000
    lines = sum(([r.randrange(50), *range(100, 112)] for _ in range(1500)), [])
    got = periodic.runs_together(np.array(same + lines), np.array([len(same), len(lines)]), 6, 4)
    assert got[0] == [(0, 20_000, 1)] and got.get(1, []) == slow_runs(lines, 6, 4)


def test_periodic_runs_over_the_edge_cases(docs, rows, none):
    got = {}
    for x in periodic.periodic_runs(docs).collect():
        got.setdefault(x.doc_id, []).append((x.n_words, [tuple(r) for r in x.runs], x.collapsed))
    for i, text, _ in rows:
        words = (text or "").encode().split()
        runs = slow_runs(words, 6, 4) if len(words) < 2000 else []
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        assert (len(words), runs, b" ".join(w for k, w in enumerate(words) if k not in gone).decode()) in got[i]
    assert periodic.periodic_runs(none).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, times=1)


def test_collapsed_text(spark):
    df = spark.createDataFrame([(1, "x " + "a b " * 5 + "a c"), (2, "a a a a a"), (3, "a a a a a a"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(df).collect()}
    assert got == {1: ([(1, 11, 2)], "x a b c"), 2: ([], "a a a a a"), 3: ([(0, 6, 1)], "a"), 4: ([], "")}


def written(text):
    return re.sub(chat.PLAIN, lambda m: m[0] + chat.MARK, text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([chat.MARK, "<", "[", "s>", "/s>", "INST]", "/INST]", "<SYS>>", "</SYS>>", "|im_start|>", "|im_end|>", "\n", "\\", "a"]), max_size=12).map("".join))
def test_escape_is_reversible(text):
    marked = written(text)
    assert chat.unescaped(marked) == text
    assert not re.search(r"<(\|im_start\||\|im_end\||s|/s|<SYS>|</SYS>)>|\[/?INST\]", marked)


def test_spark_escapes_as_python_does(spark):
    texts = ["</s>[INST] ok [/INST]", f"<{chat.MARK}s> <<SYS>>", "plain $1 \\ <b>", "<|im_end|>\n<|im_start|>user\n"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(chat.escaped("t")).collect()
    assert [r[0] for r in got] == list(map(written, texts))


def turns_of(df):
    return sorted(((r.id, r.layout, r.seq, r.role, r.text) for r in df.collect()), key=str)


RECORDS = [
    '{"id": 1, "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": null}], "lang": "en"}',
    '{"id": 2, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "tool", "value": "t"}]}',
    '{"id": 3, "prompt": "q", "completion": "a"}',
    '{"id": 4, "system": "s", "prompt": "q", "completion": "a"}',
    '{"id": 5, "instruction": "q", "input": "more", "output": "a"}',
    '{"id": 6, "instruction": "q", "output": "a"}',
    '{"id": 7, "turn": 4, "role": "user", "text": "q"}',
    '{"id": 8, "prompt": "q"}',
    '{"id": 9, "prompt": "q", "completion": "a", "role": "user"}',
    '{"id": 10, "lang": "de"}',
]


def test_layouts_become_canonical_turns(spark):
    records = spark.read.json(spark.sparkContext.parallelize(RECORDS))
    assert turns_of(chat.canonical(records, "id")) == sorted([
        (1, "messages", 0, "user", "q"), (1, "messages", 1, "assistant", ""), (2, "from_value", 0, "user", "q"), (2, "from_value", 1, "assistant", "a"), (2, "from_value", 2, "tool", "t"),
        (3, "prompt", 1, "user", "q"), (3, "prompt", 2, "assistant", "a"), (4, "prompt", 0, "system", "s"), (4, "prompt", 1, "user", "q"), (4, "prompt", 2, "assistant", "a"),
        (5, "instruction", 0, "user", "q\n\nmore"), (5, "instruction", 1, "assistant", "a"), (6, "instruction", 0, "user", "q"), (6, "instruction", 1, "assistant", "a"), (7, "turn", 4, "user", "q"),
    ], key=str)
    left = {tuple(r.paths): r.records for r in chat.unknown(records).collect()}
    assert left == {("prompt",): 1, ("completion", "prompt", "role"): 1, (): 1}


def test_layouts_without_their_columns(spark):
    only = spark.createDataFrame([(1, "q", "a")], "id long, prompt string, completion string")
    assert len(turns_of(chat.canonical(only, "id"))) == 2
    assert turns_of(chat.canonical(only.select("id"), "id")) == []
    with pytest.raises(ValueError):
        chat.registry((*chat.LAYOUTS, chat.Layout("again", turns=(("user", ("prompt",)), ("assistant", ("completion",))))))


TURNS = [(c, t, r, x) for c in (1, 2, None) for t, r, x in [(None, "system", "s"), (0, "user", "q <|im_end|>"), (0, "user", "q <|im_end|>"), (1, "assistant", "[INST] é"), (2, None, None), (3, "a\\n\nb<s>", "\n"), (4, "assistant", "")]]


@pytest.mark.parametrize("part_chars", [1, 60, 1 << 20])
def test_formatted_turns_read_back(spark, part_chars):
    turns = spark.createDataFrame(TURNS, "id long, seq long, role string, text string").repartition(3)
    formatted = chat.format_turns(turns, "id", part_chars)
    parts = sorted(formatted.collect(), key=lambda r: r.part)
    for c in (1, 2, None):
        want = [(r or "", x or "") for i, _, r, x in TURNS if i == c]
        text = "".join(p.text for p in parts if p.id == c)
        assert chat.parsed(text) == want
        loss = [p.text[s.start : s.end] for p in parts if p.id == c for s in p.loss]
        assert list(map(chat.unescaped, loss)) == [x for r, x in want if r == "assistant"]
        got = next(r for r in chat.read_back(formatted, "id").collect() if r.id == c)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert got[1:] == (7, sha("".join(f"{r}\n{x}\n" for r, x in want)), 8, sha("[INST] é"), len(text))
    assert chat.read_back(chat.format_turns(turns.limit(0), "id"), "id").count() == 0
    with pytest.raises(ValueError):
        chat.parsed("<|im_start|>user\nx<|im_end|>\nrest")


def test_a_conversation_over_many_tasks(spark):
    turns = spark.range(20_000).selectExpr("7L AS id", "id AS seq", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('text ', id) AS text")
    formatted = chat.format_turns(turns, "id").cache()
    assert formatted.count() >= 3
    assert chat.read_back(formatted, "id").collect()[0].n_turns == 20_000


def test_records_of_any_layout_give_the_turns_they_were_made_of(spark):
    r = random.Random(1)
    shapes = [("user", "assistant"), ("system", "user", "assistant"), ("user", "tool"), ("human", "gpt"), ("user",) * 70, ("user", "assistant", "user")]
    rows = [(c if c else None, t, who, f"{c} {t} {r.random()}" if t else None) for c in range(60) for t, who in enumerate(r.choice(shapes))]
    made = chat.from_turns(spark.createDataFrame(rows, "conv long, turn long, role string, text string").withColumn("prompt", chat.F.lit("x")), "conv")
    got = chat.canonical(made, "conv").collect()
    assert sorted(((x.conv, x.role, x.text) for x in got), key=str) == sorted(((c, who, t or "") for c, _, who, t in rows), key=str)
    assert {x.layout for x in got} == {x.name for x in chat.LAYOUTS}


def cheapest(initials, faults):
    """Every sequence of edits, cheapest first, then in ASCII order."""
    heap, n = [(0, "", 0, "")], len(initials)
    best = None
    while heap:
        cost, audit, i, out = heapq.heappop(heap)
        if best and cost > best[0]:
            return best
        if i == n and re.fullmatch("(s?(ua)+)?", out) and (best is None or (cost, audit) < best):
            best = (cost, audit)
        if re.fullmatch("s?(ua)*u?", out):
            ways = [(2, "I", x, 0) for x in "ua"]
            if i < n:
                ways += [(3, "D", "", 1)]
                if faults[i] < 2:
                    ways += [(faults[i], "K", initials[i], 1)] * bool(initials[i]) + [(2 + faults[i], "R", x, 1) for x in "ua"]
            for c, letter, x, step in ways:
                heapq.heappush(heap, (cost + c, audit + letter, i + step, out + x))


def test_repair_against_every_sequence_of_edits():
    r = random.Random(6)
    for _ in range(150):
        initials = [r.choice(["u", "a", "s", "t", ""]) for _ in range(r.randint(0, 5))]
        faults = [r.choice([0, 0, 1, 2]) for _ in initials]
        assert repair.solve(initials, faults)[0] == cheapest(initials, faults)


def damaged_rows(r):
    texts = ["a.", "b.", "c", "", " \t", None, "d! ", "e?\n", "x", "."]
    return [(c, r.choice([t, t, t, None, 2]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), r.choice(texts), 1, "x") for c in [*range(40), None] for t in range(r.randint(1, 14) if c != 7 else 90)]


def summed(parts):
    out = {}
    for x in sorted(parts, key=lambda x: x.part):
        counts, audit, turns = out.get(x.id, ([0] * 6, "", []))
        out[x.id] = ([a + b for a, b in zip(counts, [x[c] for c in (*repair.COUNTS, "cost")], strict=True)], audit + x.audit, turns + [tuple(t) for t in x.repaired])
    return out


def test_blocks_give_what_whole_conversations_give(spark):
    df = spark.createDataFrame(damaged_rows(random.Random(5)), "conv_id long, turn long, role string, text string, seq long, block string").repartition(5)
    want = summed(repair.repair(df)[0].collect())
    assert all(re.fullmatch("(s?(ua)+)?", "".join(role[0] for role, _ in turns)) for _, _, turns in want.values())
    for longest in (1, 5):
        few, long = (summed(part.collect()) for part in repair.repair(df, longest=longest))
        assert long and not few.keys() & long.keys() and few | long == want


def test_a_conversation_of_many_rows(spark):
    rows = spark.range(6000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 3 = 0, 'user', 'assistant') AS role", "concat(id % 2000, '.') AS text")
    few, long = repair.repair(rows, longest=500)
    parts = long.collect()
    assert few.count() == 0 and len(parts) >= 12
    counts, audit, turns = summed(parts)[1]
    initials, seen, faults = [], set(), []
    for i in range(6000):
        key = (i % 3 == 0, i % 2000)
        faults.append(2 if key in seen else 0)
        seen.add(key)
        initials.append("u" if i % 3 == 0 else "a")
    assert (counts[-1], audit) == repair.solve(initials, faults)[0]
    assert [r for r, _ in turns] == ["user", "assistant"] * (len(turns) // 2)


def test_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert all(part.count() == 0 for part in repair.repair(empty))
    empty.write.parquet(str(tmp_path / "conversations.parquet"))
    assert queries_turns.op13_conversation_repair(spark, str(tmp_path)).count() == 0
    assert [r.conv_id for r in queries_turns.op12_chat_formatting(spark, str(tmp_path)).collect()] == [-7]


def test_a_conversation_that_loses_all_rows(spark, tmp_path):
    import zlib

    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "x.")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries_turns.op13_conversation_repair(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
