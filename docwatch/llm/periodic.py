"""Periodic runs: stretches of words that repeat themselves, found as maximal pairs.

A run is a stretch with smallest period q (words q apart are equal) and at least max(least, times * q) words that no
neighbouring word extends. Two starts i < j of one text whose common prefix has l words and whose left words differ are
a maximal pair; with q = j - i and l >= max(least - q, (times - 1) * q) its stretch [i, j + l) has period q, and being maximal
on both sides it is a run as it stands: nothing is extended. Its other pairs at multiples of the period give the same
stretch, so the smallest distance is kept.

The pairs come from the LCP intervals of the text's suffix array, bottom up. An interval holds its starts in lists by
left word; where two children meet, the starts of the smaller one look up those of the larger one within l / (times - 1)
words, in the lists of other left words or, if those are more, among the starts of that stretch. Suffix array (prefix
doubling) and LCP are array operations over many texts at once; only intervals that can hold such a pair are walked.

Every text is worked on alone, in the task that reads it; nothing is shuffled, so copies and hot sources cost no more
than their own words.

Defined cases: a null, empty or blank text has no words and no runs, its collapsed text is empty; a very long text is worked
on whole, in memory proportional to its words; repeated rows and equal or null ids are rows of their own; an empty table
gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from docwatch.llm.common import columns

#: Words of the texts that are worked on together.
TOGETHER = 1 << 20


def floor_of(least: int, times: int) -> int:
    """The shortest common prefix that a run's pair can have."""
    return min(max(least - q, (times - 1) * q) for q in range(1, max(least, 1) + 1))


def dense(keys: np.ndarray) -> np.ndarray:
    """Ranks from 1, in the order of the keys."""
    return np.unique(keys, return_inverse=True)[1] + 1


def at(values: np.ndarray, where: np.ndarray, end: np.ndarray) -> np.ndarray:
    """values[where], 0 from a text's end on."""
    return np.where(where < end, values[np.minimum(where, len(values) - 1)], 0)


def may_repeat(codes: np.ndarray, sizes: np.ndarray, gram: int, times: int) -> np.ndarray:
    """Which texts hold two equal stretches of gram words at most 1 / times of the text apart; without them there is no run."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    if len(codes) < gram:
        return np.zeros(len(sizes), bool)
    h = np.zeros(len(codes) - gram + 1, np.uint64)
    for k in range(gram):  # equal stretches hash equal; unequal ones that do only cost time
        h = (h ^ codes[k : k + len(h)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    inside = np.flatnonzero(doc[: len(h)] == doc[gram - 1 :])
    h = h[inside] ^ (doc[inside].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = inside[np.argsort(h, kind="stable")]
    h = np.sort(h)
    near = (h[1:] == h[:-1]) & (doc[order[1:]] == doc[order[:-1]]) & ((order[1:] - order[:-1]) * times <= sizes[doc[order[1:]]])
    return np.bincount(doc[order[1:][near]], minlength=len(sizes)) > 0


def suffixes(codes: np.ndarray, doc: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of all texts, text after text, and the LCP of each suffix with the one before it (0 between texts)."""
    n, length = len(codes), 1
    ranks = [dense(doc * (int(codes.max()) + 1) + codes)]  # ranks[k]: of the first 2**k words
    while True:
        held = np.bincount(ranks[-1])
        place = (np.cumsum(held) - held + 1)[ranks[-1]]
        shared = np.flatnonzero(held[ranks[-1]] > 1)  # a suffix that stands alone keeps its place
        if not len(shared):
            break
        keys = place[shared] * (n + 1) + at(place, shared + length, end[shared])
        order = np.argsort(keys, kind="stable")
        keys, old = keys[order], place[shared[order]]
        spot = np.arange(len(order))
        own = np.maximum.accumulate(np.where(np.r_[True, keys[1:] != keys[:-1]], spot, 0))
        all_ = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], spot, 0))
        place[shared[order]] = old + own - all_
        ranks.append(place)
        length *= 2
    order = np.argsort(ranks[-1], kind="stable")
    i, j = order[:-1], order[1:]
    lcp = np.zeros(n - 1, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        a, b = at(ranks[k], i + lcp, end[i]), at(ranks[k], j + lcp, end[j])
        lcp += np.where((a == b) & (a > 0) & (doc[i] == doc[j]), 1 << k, 0)
    return order, np.r_[0, lcp]


def maximal_pairs(starts: list[int], left: list[int], lcp: list[int], times: int, found: dict[tuple[int, int], int]) -> None:
    """Walks the LCP intervals over some neighbouring suffixes bottom up. lcp[k]: with the one before, lcp[0] is not used.
    found: (start, length) to the smallest distance of the pairs with that stretch."""

    def meet(one: tuple, other: tuple, depth: int) -> tuple:
        """Two children of an interval: their pairs, then both as one. A child is (starts, lists by left word)."""
        if len(one[0]) < len(other[0]):
            one, other = other, one
        reach = depth // (times - 1)
        for word, own in other[1].items():
            for p in own:
                lo, hi = bisect_left(one[0], p - reach), bisect_right(one[0], p + reach)
                if hi - lo <= len(one[1]):
                    near = (q for q in one[0][lo:hi] if left_of[q] != word)
                else:
                    near = (q for w, qs in one[1].items() if w != word for q in qs[bisect_left(qs, p - reach) : bisect_right(qs, p + reach)])
                for q in near:
                    key = (min(p, q), depth + abs(p - q))
                    found[key] = min(found.get(key, abs(p - q)), abs(p - q))
        for word, own in other[1].items():
            mine = one[1].setdefault(word, [])
            for p in own:
                insort(one[0], p)
                insort(mine, p)
        return one

    left_of = dict(zip(starts, left, strict=True))
    leaf = lambda k: ([starts[k]], {left[k]: [starts[k]]})
    open_: list[tuple[int, tuple]] = []  # intervals from the outermost in, each with what it holds so far
    child = leaf(0)
    for k in range(1, len(starts) + 1):
        depth = lcp[k] if k < len(starts) else -1
        while open_ and open_[-1][0] > depth:
            ell, held = open_.pop()
            child = meet(held, child, ell)
        if open_ and open_[-1][0] == depth:
            open_[-1] = (depth, meet(open_[-1][1], child, depth))
        else:
            open_.append((depth, child))
        child = leaf(k) if k < len(starts) else child


def runs_together(codes: np.ndarray, sizes: np.ndarray, least: int, times: int) -> dict[int, list[tuple[int, int, int]]]:
    """The runs (start, length, period) of the texts that have any, in order; texts follow one another in codes."""
    gram = floor_of(least, times)
    chosen = np.flatnonzero(may_repeat(codes, sizes, gram, times))
    if not len(chosen):
        return {}
    codes, sizes = codes[np.repeat(np.isin(np.arange(len(sizes)), chosen), sizes)], sizes[chosen]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    end = np.repeat(np.cumsum(sizes), sizes)
    first = end - np.repeat(sizes, sizes)
    order, lcp = suffixes(codes, doc, end)
    left = np.where(order == first[order], -1, codes[order - 1])
    # stretches of the suffix array that share gram words; lcp of a stretch's first suffix doesn't count
    begins = np.flatnonzero(np.r_[True, lcp[1:] < gram])
    ends = np.r_[begins[1:], len(order)]
    group = np.repeat(np.arange(len(begins)), ends - begins)
    inner = np.r_[False, group[1:] == group[:-1]]
    deepest = np.maximum.reduceat(np.where(inner, lcp, 0), begins)
    several = np.zeros(len(begins), bool)
    np.logical_or.at(several, group[1:], inner[1:] & (left[1:] != left[:-1]))
    by_start = np.lexsort((order, group))
    gaps = np.where(inner, np.r_[0, order[by_start][1:] - order[by_start][:-1]], len(order) + 1)
    nearest = np.minimum.reduceat(gaps, begins)
    out: dict[int, list[tuple[int, int, int]]] = {}
    for g in np.flatnonzero(several & (nearest * (times - 1) <= deepest)):
        part, found = slice(begins[g], ends[g]), {}
        maximal_pairs(order[part].tolist(), left[part].tolist(), lcp[part].tolist(), times, found)
        d = int(doc[order[begins[g]]])
        low = int(first[order[begins[g]]])
        out.setdefault(d, []).extend((i - low, n, q) for (i, n), q in found.items() if n >= max(least, times * q))
    return {int(chosen[d]): sorted(_smallest(runs)) for d, runs in out.items() if runs}


def _smallest(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """A stretch's pairs at multiples of its period may meet in other parts of the suffix array."""
    best: dict[tuple[int, int], int] = {}
    for i, n, q in runs:
        best[i, n] = min(best.get((i, n), q), q)
    return [(i, n, q) for (i, n), q in best.items()]


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed): a row's runs in order of start and period, and its words, joined by one space, without
    those that any run holds after its first period. least: words that a run has; times: periods that it has; both 2 or more."""
    if least < 2 or times < 2:
        raise ValueError("a run has two words and two periods at least")
    rows = columns(docs, id=id, text=text)

    def work(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            begin = 0
            while begin < len(texts):
                words, sizes, k = [], [], begin
                while k < len(texts) and (k == begin or len(words) < TOGETHER):
                    words += (own := (texts[k] or "").encode().split())
                    sizes.append(len(own))
                    k += 1
                codes = pd.factorize(np.array(words, dtype=object))[0] if words else np.zeros(0, np.int64)
                runs = runs_together(codes.astype(np.int64), np.array(sizes), least, times)
                collapsed, low = [], 0
                for d, n in enumerate(sizes):
                    own = words[low : low + n]
                    if d in runs:
                        keep = np.ones(n, bool)
                        for i, size, q in runs[d]:
                            keep[i + q : i + size] = False
                        own = [own[i] for i in np.flatnonzero(keep)]
                    collapsed.append(b" ".join(own).decode())
                    low += n
                of = [[{"start": i, "length": n, "period": q} for i, n, q in runs.get(d, ())] for d in range(len(sizes))]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays([ids[begin:k], pa.array(sizes, pa.int64()), pa.array(of, kind), pa.array(collapsed, pa.string())], names=["id", "n_words", "runs", "collapsed"])
                begin = k

    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return rows.mapInArrow(work, schema).withColumnRenamed("id", id)
