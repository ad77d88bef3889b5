"""URL filters: host rules by suffix, pattern rules by their rarest literal token.

A pattern is written in the usual filter syntax: `*` stands for anything, `^` for a separator or the end, `||` for
the start of a host label; a leading `@@` makes an exception, which allows what other patterns block. A pattern's
literal tokens are the runs of letters and digits that must stand whole in a matching url; it is filed under the one
that the fewest urls contain. A url's own tokens fetch the candidates, and only those run their regular expression.
Rules and index are broadcast; they are a parameter of at most max_rules entries, whatever the number of urls.

Defined cases: a null url or one without `://` has an empty host and path; it fits no rule and is allowed; repeated
urls are judged alike; an empty table gives an empty result; other columns are kept out of the way.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwatch.llm.common import columns

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = re.compile(r"[a-z0-9]+")


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def compile_pattern(rule: str) -> tuple[str, str, list[str]]:
    """(verdict, regular expression, literal tokens) of a pattern; matching is on the lower-cased url."""
    verdict, body = ("allow", rule[2:]) if rule.startswith("@@") else ("block", rule)
    label, body = body.startswith("||"), body.removeprefix("||").lower()
    regex = "".join({"*": ".*", "^": "(?:[^a-z0-9_.%-]|$)"}.get(ch, re.escape(ch)) for ch in body)
    tokens = []
    for m in TOKEN.finditer(body):
        whole_left = m.start() > 0 and body[m.start() - 1] != "*" or m.start() == 0 and label
        whole_right = m.end() < len(body) and body[m.end()] != "*"
        if whole_left and whole_right:
            tokens.append(m.group())
    return verdict, (r"://(?:[^/?#]*\.)?" if label else "") + regex, tokens


def judge(pages: DataFrame, host_rules: list[tuple[str, str, str]], patterns: list[str], page_id: str = "page_id", url: str = "url", max_rules: int = 100_000) -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern): host_rules are (verdict, host, path); the longest that fits wins, else the patterns decide."""
    if len(host_rules) + len(patterns) > max_rules:
        raise ValueError(f"more than {max_rules} rules")
    slim = columns(pages, page_id=page_id, url=url)
    compiled = [(p, *compile_pattern(p)) for p in patterns]
    wanted = sorted({t for *_, tokens in compiled for t in tokens})
    of_url = F.array_distinct(F.regexp_extract_all(F.translate("url", UPPER, LOWER), F.lit("([a-z0-9]+)"), 1))
    counts = dict.fromkeys(wanted, 0)
    if wanted:
        counts |= {r[0]: r[1] for r in slim.select(F.explode(of_url).alias("t")).where(F.col("t").isin(wanted)).groupBy("t").count().collect()}  # at most a row per rule token
    index: dict[str, list[tuple[str, str, str]]] = {}
    for pattern, verdict, regex, tokens in compiled:
        index.setdefault(min(tokens, key=lambda t: (counts[t], t)) if tokens else "", []).append((pattern, verdict, regex))
    by_host: dict[str, list[tuple[str, str]]] = {}
    for verdict, host, path in host_rules:
        by_host.setdefault(host, []).append((path, verdict))
    shared = slim.sparkSession.sparkContext.broadcast((index, by_host))
    host, path = host_and_path(F.col("url"))
    kind = slim.schema["page_id"].dataType.simpleString()

    def work(batches):
        index, by_host = shared.value
        ready = {t: [(p, v, re.compile(r, re.S)) for p, v, r in rules] for t, rules in index.items()}
        table = str.maketrans(UPPER, LOWER)

        def fit(host: str, path: str):
            found, at = [], 0
            while host and at >= 0:
                suffix = host[at:]
                found += [(len(suffix) + len(p), suffix + p, v) for p, v in by_host.get(suffix, ()) if path.startswith(p)]
                at = host.find(".", at) + 1 or -1
            return max(found)[1:] if found else (None, None)

        def run(url: str):
            low = url.translate(table)
            hits = [(p, v) for t in ["", *sorted(set(TOKEN.findall(low)))] for p, v, r in ready.get(t, ()) if r.search(low)]
            return min(hits, key=lambda h: (h[1], h[0])) if hits else (None, "allow")

        for batch in batches:
            out = []
            for u, h, p in zip(*(batch.column(c).to_pylist() for c in ("url", "host", "path"))):
                rule, verdict = fit(h, p)
                pattern, other = run(u) if u and h else (None, "allow")
                out.append((rule, verdict or other, pattern))
            cols = [pa.array([x[k] for x in out], pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), batch.column("path"), *cols], names=["page_id", "host", "path", "rule", "verdict", "pattern"])

    return slim.withColumn("host", host).withColumn("path", path).mapInArrow(work, f"page_id {kind}, host string, path string, rule string, verdict string, pattern string")
