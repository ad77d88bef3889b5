"""Periodic runs, chat formatting and conversation repair as queries over the given tables, and their SQL."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docwatch.llm import chat, periodic, repair
from docwatch.llm.common import WORD, table

#: A conversation whose texts hold nothing but control strings of a template: fixed values.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def made_periodic(doc_id: Column, text: Column) -> Column:
    """Every tenth document's words repeat themselves from some word on: with h the id's CRC-32 and g = h / 10, word i from
    a = g % n on becomes word a + (i - a) % p of the text, p = 1 + (n - a) / (3 + g % 8)."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, g = F.size(words).cast("long"), F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    period = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(period, (F.floor((n - a) / p) + 1).cast("int"))), F.lit(1), (n - a).cast("int"))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = periodic.periodic_runs(docs.select("doc_id", made_periodic(F.col("doc_id"), F.col("text")).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("short"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    rows = rows.withColumn("best", best)
    length, period = F.col("best.length"), -F.col("best.short")
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.before")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
                       F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    turns = chat.canonical(chat.from_turns(given.union(probe), "conv_id"), "conv_id")
    return chat.read_back(chat.format_turns(turns, "conv_id"), "conv_id")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults by the CRC-32 of `conv_id:turn`, modulo 20: 0 drops the row, 1 empties its
    text, 2 takes its sentence ends, 3 repeats it, 4 makes it the user's. Nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    few, long = repair.repair(damaged(given))
    lines = F.array_join(F.transform("repaired", lambda t: F.concat_ws(":", t["role"], t["text"])), "\n")
    counts = [*repair.COUNTS, "cost"]
    one = few.select("id", *counts, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    parts = long.select("id", "part", *counts, "audit", lines.alias("lines"), (F.size("repaired") > 0).alias("some")).repartition("id").sortWithinPartitions(F.col("id").asc_nulls_first(), "part")
    done = one.union(parts.mapInArrow(joined_parts(len(counts)), one.schema))
    ids = given.select("conv_id").distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return ids.join(done, ids["conv_id"].eqNullSafe(done["id"]), "left").select("conv_id", *map(zero, counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def joined_parts(n: int):
    """Adds up the parts of long conversations, which come in order, and digests their lines one part at a time."""

    def row(who, sums, audits, digest):
        kinds = [pa.int64()] * (n + 1) + [pa.string()] * 2
        values = [who, *sums, "".join(audits), digest.hexdigest()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["id", *repair.COUNTS, "cost", "audit", "repaired_sha256"])

    def work(batches):
        now, sums, audits, digest, any_ = None, None, [], None, False
        for who, _, *rest in chat.streamed(batches, 16):
            if sums is not None and who != now:
                yield row(now, sums, audits, digest)
                sums = None
            if sums is None:
                now, sums, audits, digest, any_ = who, [0] * n, [], hashlib.sha256(), False
            sums = [a + b for a, b in zip(sums, rest[:n], strict=True)]
            audits.append(rest[n])
            if rest[n + 2]:
                digest.update((("\n" if any_ else "") + rest[n + 1]).encode())
                any_ = True
        if sums is not None:
            yield row(now, sums, audits, digest)

    return work


#: CRC-32 of a string of ASCII characters, bit by bit: fixed values are the polynomial and the mask.
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({0}, ''), lambda ch: list_transform(range(8), lambda k: (ord(ch) >> k) & 1)))),
    lambda c, b: xor(c >> 1, CASE WHEN (xor(c, b) & 1) = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"""


def repair_sql() -> str:
    """The least weight per row and state, from the last row back: a weight is the cost in eight digits, the letters, chr(1) and the
    repaired lines, so text order is the order of weights."""

    def first(cost: str, letter: str, line: str, rest: str) -> str:
        at = f"strpos({rest}, chr(1))"
        return f"lpad(CAST(CAST(substr({rest}, 1, 8) AS INTEGER) + {cost} AS VARCHAR), 8, '0') || '{letter}' || substr({rest}, 9, {at} - 9) || chr(1) || {line} || substr({rest}, {at} + 1)"

    made = ["chr(10) || 'user:'", "chr(10) || 'user:'", "chr(10) || 'assistant:'", "chr(10) || 'user:'"]
    kept = "CASE WHEN initial = '{}' AND fault < 2 THEN {} END"
    plain, inserts = [], lambda level, into: ", ".join(f"least({level}{s}, {first('2', 'I', made[s], f'{into}{repair.NEXT[s][1]}')}) AS {{}}{s}" for s in range(4))
    for s in range(4):
        keep = [kept.format(i, first("fault", "K", "chr(10) || role || ':' || text", f"w{to}")) for i, to in repair.AFTER[s].items()]
        rerole = f"CASE WHEN fault < 2 THEN {first('2 + fault', 'R', f'{made[s]} || text', f'w{repair.NEXT[s][1]}')} END"
        plain.append(f"least({', '.join([*keep, rerole, first('3', 'D', chr(39) * 2, f'w{s}')])}) AS p{s}")
    closing = ["'00000000' || chr(1)", "'00000004II' || chr(1) || chr(10) || 'user:' || chr(10) || 'assistant:'", "'00000002I' || chr(1) || chr(10) || 'assistant:'", "'00000000' || chr(1)"]
    return rf"""
        WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC32.format("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS f FROM conversations),
        d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE f <> 0),
        k AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM d),
        n AS (SELECT *, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again FROM k),
        f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 3 WHEN again THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 1 ELSE 0 END AS fault FROM n),
        w AS (SELECT conv_id, max(k) + 1 AS k, {", ".join(f"{x} AS w{s}" for s, x in enumerate(closing))} FROM f GROUP BY conv_id
            UNION ALL SELECT conv_id, k, {inserts("p", "o").format(*"wwww")} FROM
            (SELECT *, {inserts("p", "p").format(*"oooo")} FROM (SELECT f.conv_id, f.k, {", ".join(plain)} FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.k = w.k - 1))),
        b AS (SELECT conv_id, w0 AS x, strpos(w0, chr(1)) AS cut FROM w WHERE k = 1),
        s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1, 0) - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 3) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 1) AS truncated,
            count(*) FILTER (k > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            coalesce(CAST(substr(x, 1, 8) AS BIGINT), 0) AS cost, coalesce(substr(x, 9, cut - 9), '') AS audit, sha256(coalesce(substr(x, cut + 2), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM o.conv_id"""


ORACLES = {
    "op11_periodic_runs": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, {CRC32.format("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
        a AS (SELECT doc_id, ws, len(ws) AS n, h, h // 10 AS g, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM d),
        p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
        t AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE ws END AS ws FROM p),
        w AS (SELECT doc_id, n, unnest(ws) AS w, unnest(range(n)) AS i FROM t WHERE n > 0),
        k AS (SELECT doc_id, n, unnest(range(n - 4)) AS i, ws FROM t WHERE n >= 5),
        s AS (SELECT doc_id, n, i, array_to_string(ws[i + 1:i + 5], ' ') AS five FROM k),
        m AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM s x JOIN s y ON x.doc_id = y.doc_id AND x.five = y.five AND y.i > x.i AND (y.i - x.i) * 4 <= x.n),
        v AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m),
        u AS (SELECT doc_id, q, min(i) AS start, count(*) + 4 + q AS length FROM v GROUP BY doc_id, q, island),
        r AS (SELECT doc_id, start, length, min(q) AS period FROM u WHERE length >= 4 * q AND length >= 6 GROUP BY ALL),
        x AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
        c AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept FROM w ANTI JOIN x USING (doc_id, i) GROUP BY doc_id),
        b AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
        o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1)
        SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
        FROM t LEFT JOIN b USING (doc_id) LEFT JOIN o USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op12_chat_formatting": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
        c AS (SELECT *, '<' || chr(8288) || '*(?:\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|eot_id\|>|\|start_header_id\|>|\|end_header_id\|>|s>|/s>|<SYS>>|</SYS>>)|\[' || chr(8288) || '*(?:INST\]|/INST\])' AS control FROM t),
        n AS (SELECT conv_id, turn, role, text, 24 + length(text) + len(regexp_extract_all(text, control)) + length(role) + len(regexp_extract_all(role, control || '|\n|\\')) AS chars FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
        FROM n GROUP BY conv_id""",
    "op13_conversation_repair": repair_sql(),
}

QUERIES = {f.__name__: f for f in (op11_periodic_runs, op12_chat_formatting, op13_conversation_repair)}
