"""SimHash near-duplicates with a bit-sliced comparison.

A fingerprint's 64 bits are stored vertically: plane b holds bit b of 64 fingerprints in one machine word. A query
is compared with 64 fingerprints at once by exclusive-or of planes; the differing bits are counted by carry-save
adders in three counter planes and an overflow plane; a word whose 64 distances all exceed the radius is abandoned.

Which fingerprints meet at all is decided by pigeonhole: of `blocks` bit blocks at least blocks - radius agree
exactly in a linked pair, so every choice of that many blocks is a table keyed by their bits. Equal fingerprints are
one row. A key with more than `tile` fingerprints is cut into sub-blocks that are compared pair by pair in tasks of
their own. A task gives a star per group and tile, not the pairs, so the edges stay linear in the fingerprints.

Defined cases: null text counts as empty; a text without words has fingerprint 0 and is linked like any other; equal
rows stay, each with its own result row; a null id stays null and never becomes a component's id unless the
component has no other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docwatch.llm.common import columns, components, cut, roots
from docwatch.operators.checkpoints import renewed

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int, seed: int = 42) -> int:
    """64 bits; a bit is set if more than half of the shingles' XXH64 values have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    one, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    stops = (ends - 1).tolist()
    hashes = [digest(one[a:b], seed) for a, b in zip(starts, stops[shingle - 1 :] or stops[-1:])]
    total = np.zeros(64, np.int64)
    array = np.array(hashes, dtype="<u8")
    for part in range(0, len(array), 8192):
        total += np.unpackbits(array[part : part + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp BIGINT), a row per row of docs."""

    def work(batches):
        for batch in batches:
            values = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            fp = pa.array(np.array(values, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], names=["doc_id", "fp"])

    slim = columns(docs, doc_id=doc_id, text=text)
    return slim.mapInArrow(work, f"doc_id {slim.schema[0].dataType.simpleString()}, fp bigint")


def bit_planes(lanes: np.ndarray) -> np.ndarray:
    """(words, 64) fingerprints to (64, words) planes."""
    out = np.empty((64, len(lanes)), np.uint64)
    for k in range(0, len(lanes), 1024):
        part = np.ascontiguousarray(lanes[k : k + 1024], dtype="<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), 64, 8), axis=2, bitorder="little")
        out[:, k : k + 1024] = np.packbits(np.ascontiguousarray(bits.transpose(2, 0, 1)), axis=2, bitorder="little").reshape(64, -1).view("<u8")
    return out


def add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: three planes to a sum and a carry plane."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def within(planes: np.ndarray, word: np.ndarray, query: np.ndarray, valid: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For comparison k of query[k] (a row of 64-bit parts) with the 64 lanes of word[k]: the mask of valid lanes within radius.

    Returns the comparisons that have any, and their masks.
    """
    at = np.arange(len(word))
    counter = [np.zeros(len(word), np.uint64) for _ in range(max(3, radius.bit_length()))]  # weights 1, 2, 4, ...
    over = np.zeros(len(word), np.uint64)
    for byte in range(0, len(planes), 8):
        d = [planes[b][word] ^ np.where((query[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1), ONES, np.uint64(0)) for b in range(byte, byte + 8)]
        twos = []
        for k in range(0, 8, 2):
            counter[0], carry = add(counter[0], d[k], d[k + 1])
            twos.append(carry)
        counter[1], low = add(counter[1], twos[0], twos[1])
        counter[1], high = add(counter[1], twos[2], twos[3])
        counter[2], carry = add(counter[2], low, high)
        for k in range(3, len(counter)):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over |= carry
        more, equal = over.copy(), ONES
        for k in reversed(range(len(counter))):
            if radius >> k & 1:
                equal = equal & counter[k]
            else:
                more |= equal & counter[k]
                equal = equal & ~counter[k]
        valid = valid & ~more
        live = np.flatnonzero(valid)
        if len(live) < len(valid):
            at, word, query, valid, over = (x[live] for x in (at, word, query, valid, over))
            counter = [x[live] for x in counter]
        if not len(at):
            break
    return at, valid


def close_pairs(fps: np.ndarray, group: np.ndarray, radius: int, at_once: int):
    """Yields (row, later row) arrays of all pairs within radius among the rows of each run of equal group numbers; fps is (rows, parts)."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[starts, len(group)])
    words = -(-size // 64)
    first = np.r_[0, np.cumsum(words)[:-1]]
    of = np.repeat(np.arange(len(size)), size)
    local = np.arange(len(group)) - starts[of]
    lane_of = first[of] * 64 + local
    planes = []
    for part in range(fps.shape[1]):
        lanes = np.zeros((int(words.sum()), 64), np.uint64)
        lanes.reshape(-1)[lane_of] = fps[:, part]
        planes.append(bit_planes(lanes))
    planes = np.concatenate(planes)
    row_of = np.full(int(words.sum()) * 64, -1, np.int64)
    row_of[lane_of] = np.arange(len(group))
    todo = words[of] - local // 64
    begin = np.r_[0, np.cumsum(todo)]
    row = 0
    while row < len(group):
        upto = max(row + 1, int(np.searchsorted(begin, begin[row] + at_once, "right")) - 1)
        rows = np.repeat(np.arange(row, upto), todo[row:upto])
        step = np.arange(len(rows)) - (begin[rows] - begin[row])
        lane_word = local[rows] // 64 + step
        left = np.minimum(size[of[rows]] - lane_word * 64, 64).astype(np.uint64)
        valid = np.where(left >= 64, ONES, (np.uint64(1) << (left % np.uint64(64))) - np.uint64(1))
        shift = (local[rows] % 64).astype(np.uint64)
        valid = np.where(step == 0, valid & ~((np.uint64(2) << shift) - np.uint64(1)), valid)
        item, mask = within(planes, first[of[rows]] + lane_word, fps[rows], valid, radius)
        if len(item):
            bits = np.unpackbits(mask.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            hit, lane = np.nonzero(bits)
            yield rows[item[hit]], row_of[(first[of[rows[item[hit]]]] + lane_word[item[hit]]) * 64 + lane]
        row = upto


def stars(fps: np.ndarray, group: np.ndarray, radius: int, at_once: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, smallest linked row) that connect what close_pairs would."""
    a = b = np.zeros(0, np.int64)
    for x, y in close_pairs(fps[:, None], group, radius, at_once):
        a, b = np.r_[a, x], np.r_[b, y]
        if len(a) > 4 * len(group):
            label = roots(len(group), a, b)
            a = np.flatnonzero(label != np.arange(len(group)))
            b = label[a]
    label = roots(len(group), a, b)
    a = np.flatnonzero(label != np.arange(len(group)))
    return a, label[a]


def by_key(compare):
    """A function for mapInArrow over rows sorted by `key`: compare(key, *other columns) sees whole runs of two rows at least."""

    def work(batches):
        held = None
        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
            held = now if held is None else [np.r_[x, y] for x, y in zip(held, now)]
            if len(held[0]):  # the last key may go on in the next batch
                end = int(np.searchsorted(held[0], held[0][-1], "left"))
                yield from whole([x[:end] for x in held])
                held = [x[end:] for x in held]
        if held is not None:
            yield from whole(held)

    def whole(rows):
        same = rows[0][1:] == rows[0][:-1]
        keep = np.r_[False, same] | np.r_[same, False] if len(rows[0]) else np.zeros(0, bool)
        rows = [x[keep] for x in rows]
        if len(rows[0]):
            yield compare(*rows)

    return work


def in_tiles(rows: DataFrame, by: str, tile: int, large: DataFrame | None = None) -> DataFrame:
    """rows(key, ...) where a key of more than `tile` rows is cut: sub-block i meets sub-block j, both whole, under a key of the pair.

    large(key, k) are these keys and their numbers of sub-blocks, if they are known."""
    large = large if large is not None else cut(rows.groupBy("key").count().where(F.col("count") > tile).select("key", F.ceil(F.col("count") * 2 / tile).cast("int").alias("k")))
    if large.isEmpty():
        return rows
    cols = rows.columns
    tiles = rows.join(large, "key", "left").withColumn("i", F.pmod(F.xxhash64(by), F.coalesce("k", F.lit(1))).cast("int"))
    tiles = tiles.withColumn("j", F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1)))
    pair = F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j"))
    return tiles.withColumn("key", F.when(F.col("k").isNull(), F.col("key")).otherwise(pair)).select(*cols)


def links(fps: DataFrame, radius: int = 4, blocks: int | None = None, tile: int = 1 << 15) -> DataFrame:
    """Edges (u, v) that connect all fp BIGINT within radius of each other, transitively as the full set would."""
    blocks = blocks or radius + 2
    widths = [64 // blocks + (k < 64 % blocks) for k in range(blocks)]
    lows = [sum(widths[:k]) for k in range(blocks)]
    part = [F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1)) for low, width in zip(lows, widths)]
    keys = []
    for t, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        keys.append(F.xxhash64(F.lit(t), *(part[k] for k in chosen)))
    distinct = fps.select("fp").distinct()
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    tiles = in_tiles(rows, "fp", tile)

    def compare(key, fp):
        a, b = stars(fp.view(np.uint64), key, radius)
        return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["u", "v"])

    dealt = tiles.repartition("key").sortWithinPartitions("key", "fp")
    return dealt.select("key", "fp").mapInArrow(by_key(compare), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id), a row per row of docs; component_id is the smallest doc_id reachable by links."""
    fps = cut(fingerprints(docs, doc_id, text, shingle))
    found = components(links(fps, radius))
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = least.join(found, least.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted)
    per_root = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = cut(rooted.join(per_root, "root").select("fp", "component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def mixed(x: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser of x + salt: independent, well-spread values."""
    x = x + salt * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `shingle` words (fewer words: the whole sequence; none: nothing)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(shingle, len(one))
    total = np.zeros(len(one) - width + 1, np.uint64)
    for k in range(width):
        total = total * np.uint64(0xC2B2AE3D27D4EB4F) + one[k : len(one) - width + 1 + k]
    total = np.sort(mixed(total, np.array([width], np.uint64)))
    return total[np.r_[True, total[1:] != total[:-1]]]


#: A wide fingerprint: 16 words of 64 bits, of which the first 4 have bit planes.
WORDS, PLANED = 16, 4
SIGNATURE = tuple(f"s{k}" for k in range(WORDS))


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """SimHash of 64 * WORDS bits of a set: a bit is set if more than half of the shingles' hashes have it."""
    total = np.zeros(64 * WORDS, np.int64)
    for k in range(0, len(shingles), 255):
        hashes = mixed(shingles[k : k + 255, None], np.arange(1, WORDS + 1, dtype=np.uint64))
        total += np.add.reduce(np.unpackbits(hashes.astype("<u8").view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(shingles), bitorder="little").view("<u8")


def below(k: np.ndarray) -> np.ndarray:
    """Words with the lowest k bits set; k may be negative or beyond 64."""
    k = np.clip(k, 0, 64)
    return np.where(k >= 64, ONES, (np.uint64(1) << (k.astype(np.uint64) & np.uint64(63))) - np.uint64(1))


def shared_counts(sets: list[np.ndarray], u: np.ndarray, v: np.ndarray, width: int = 1 << 16, at_once: int = 1 << 12) -> np.ndarray:
    """How many members the sorted sets u[k] and v[k] share: members of several sets become bits, `width` of them at a time."""
    count = np.zeros(len(u), np.int64)
    members = np.concatenate(sets) if sets else np.zeros(0, np.uint32)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, number, times = np.unique(members, return_inverse=True, return_counts=True)
    several = times > 1
    number, row = (np.cumsum(several) - 1)[number[several[number]]], row[several[number]]
    for low in range(0, int(several.sum()), width):
        inside = (number >= low) & (number < low + width)
        bits = np.zeros((len(sets), width // 8), np.uint8)
        at = number[inside] - low
        np.bitwise_or.at(bits, (row[inside], at >> 3), (1 << (at & 7)).astype(np.uint8))
        bits = bits[:, : (min(width, int(several.sum()) - low) + 63) // 64 * 8].copy().view(np.uint64)
        for k in range(0, len(u), at_once):
            count[k : k + at_once] += np.bitwise_count(bits[u[k : k + at_once]] & bits[v[k : k + at_once]]).sum(axis=1, dtype=np.int64)
    return count


def partners(group, root, size, home, sig, similarity: float, radius: int, limit: int, sets=None, at_once: int = 1 << 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other row) pairs of a group within radius, of different roots and possibly similar sizes, and a mask of the rows of
    groups that have more of them. Rows come by group, then root.

    Only home rows have lanes in the bit planes, which hold the first quarter of the bits; what is within a third of the radius there
    is compared in full. A home row meets the home rows of earlier roots, a visitor those of all other roots, word by word; it keeps
    the `limit` nearest. Without sets it stops once one of them is so near that it is hardly in doubt; with the rows' shingles
    (sets, as bytes of sorted uint32) only pairs count whose sets are similar.
    """
    n = len(group)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))
    turns = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (root[1:] != root[:-1])])
    turn = np.repeat(np.arange(len(turns)), np.diff(np.r_[turns, n]))
    before = np.r_[0, np.cumsum(home)]
    lanes = np.diff(before[np.r_[starts, n]])
    base = before[starts][of]
    own, own_end = before[turns][turn] - base, before[np.r_[turns[1:], n]][turn] - base  # the lanes of a row's own root
    stop = np.where(home, own, lanes[of])
    words = -(-lanes // 64)
    first = np.r_[0, np.cumsum(words)[:-1]][of]
    homes = np.flatnonzero(home)
    lane_of = first[homes] * 64 + before[homes] - base[homes]
    row_of = np.full(int(words.sum()) * 64, -1, np.int64)
    row_of[lane_of] = homes
    planes = []
    for part in range(PLANED):
        lane = np.zeros(len(row_of), np.uint64)
        lane[lane_of] = sig[homes, part]
        planes.append(bit_planes(lane.reshape(-1, 64)))
    planes = np.concatenate(planes)
    more, sure = np.zeros(len(starts), bool), np.zeros(n, bool)
    held, parts, waiting = np.zeros((3, 0), np.int64), [], 0  # row, distance, other row

    def similar(pairs):
        if sets is None or not pairs.shape[1]:
            return pairs
        rows, ends = np.unique(pairs[[0, 2]], return_inverse=True)
        own = [np.frombuffer(sets[k], np.uint32) for k in rows]
        a, b = ends.reshape(2, -1)
        sizes, both = np.array([len(x) for x in own]), shared_counts(own, a, b)
        return pairs[:, both >= similarity * (sizes[a] + sizes[b] - both) - 1e-6]

    def nearest():
        now = np.concatenate([held, similar(np.concatenate([held[:, :0], *parts], axis=1))], axis=1)
        now = now[:, np.lexsort((now[2], now[1], now[0]))]
        heads = np.flatnonzero(np.r_[True, now[0, 1:] != now[0, :-1]]) if now.shape[1] else np.zeros(0, np.int64)
        rank = np.arange(now.shape[1]) - np.repeat(heads, np.diff(np.r_[heads, now.shape[1]]))
        more[of[now[0, rank >= limit]]] = True
        return now[:, rank < limit]

    todo, step = np.flatnonzero(stop > 0), 0
    while len(todo):
        for k in range(0, len(todo), at_once):
            x = todo[k : k + at_once]
            at_lane = 64 * step
            valid = below(stop[x] - at_lane) & ~(below(own_end[x] - at_lane) & ~below(own[x] - at_lane))
            at, mask = within(planes, first[x] + step, sig[x, :PLANED], valid, radius * 33 // 100)
            if not len(at):
                continue
            bits = np.unpackbits(mask.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            hit, lane = np.nonzero(bits)
            u = x[at[hit]]
            v = row_of[(first[u] + step) * 64 + lane]
            fits = np.minimum(size[u], size[v]) >= similarity * np.maximum(size[u], size[v]) - 1e-6
            u, v = u[fits], v[fits]
            distance = np.bitwise_count(sig[u] ^ sig[v]).sum(axis=1, dtype=np.int64)
            fits = distance <= radius
            u, v, distance = u[fits], v[fits], distance[fits]
            sure[u[distance <= radius * 2 // 3]] = True
            parts.append(np.stack([u, distance, v]))
            waiting += len(u)
            if waiting > 1 << 20:
                held, parts, waiting = nearest(), [], 0
        step += 1
        todo = todo[stop[todo] > 64 * step]
        if sets is None:
            more[of[todo[sure[todo]]]] = True
            todo = todo[~sure[todo]]
    held = nearest()
    return held[0], held[2], more[of]


def classes_of(docs: DataFrame, shingle: int, pool: int) -> DataFrame:
    """docs(doc_id, text) to a row per set of shingles: (node, doc_id, t1, t2, size, pool, s0 .. s15). node numbers the class; doc_id
    and two hashes of the text are those of its smallest row; pool holds the smallest shingle hashes of the set."""

    def work(batches):
        for batch in batches:
            digests, sizes, pools, sigs = [], [], [], np.zeros((batch.num_rows, WORDS), np.uint64)
            for k, t in enumerate(batch.column(3).to_pylist()):
                own = shingle_set(t, shingle)
                digests.append(xxhash.xxh3_128_digest(own.astype("<u8").tobytes()))
                sizes.append(len(own))
                pools.append(own[:pool].view(np.int64))
                sigs[k] = wide_fingerprint(own)
            arrays = [*(batch.column(k) for k in range(3)), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(pools, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(sigs[:, k].copy().view(np.int64)) for k in range(WORDS))], names=["doc_id", "t1", "t2", "words", "size", "pool", *SIGNATURE])

    rows = docs.select("doc_id", *text_hashes("text"), "text")
    seen = rows.mapInArrow(work, "doc_id bigint, t1 bigint, t2 bigint, words binary, size bigint, pool array<bigint>, " + ", ".join(f"{c} bigint" for c in SIGNATURE))
    head = F.min(F.struct("doc_id", "t1", "t2")).alias("head")
    sets = seen.groupBy("words").agg(head, *(F.first(c).alias(c) for c in ("size", "pool", *SIGNATURE)))
    return cut(sets.select(F.monotonically_increasing_id().alias("node"), "head.*", "size", "pool", *SIGNATURE))


def text_hashes(text: str) -> list[F.Column]:
    """Two 64-bit hashes, t1 and t2, that tell the texts of an id apart."""
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return [F.xxhash64(value).alias("t1"), F.xxhash64(F.lit(5), value).alias("t2")]


def keyed(classes: DataFrame, keys: int, tile: int) -> DataFrame:
    """(key, node, root, size, s0 .. s15): each class under its `keys` smallest shingles that are not hot; one whose pool is hot by
    half at least under as many hot ones too. Hot are shingles in more than `tile` pools, 2**17 shingles at most."""
    held = classes.select(F.explode("pool").alias("key")).groupBy("key").count()
    entries = classes.agg(F.sum(F.size("pool"))).first()[0] or 0
    hot = held.where(F.col("count") > max(tile, entries >> 17)).select("key").toPandas()["key"].to_numpy(np.int64)
    shared = classes.sparkSession.sparkContext.broadcast(np.sort(hot))  # entries / (entries / 2**17) keys at most

    def work(batches):
        hot = shared.value
        for batch in batches:
            chosen = []
            for pool in batch.column("pool").to_pylist():
                own = np.array(pool, np.int64)
                is_hot = np.isin(own, hot)
                rare = own[~is_hot][:keys]
                chosen.append(np.r_[rare, own[is_hot][:keys]] if 2 * is_hot.sum() >= len(own) else rare)
            yield batch.drop_columns(["pool"]).append_column("keys", pa.array(chosen, pa.list_(pa.int64())))

    cols = ["node", "size", *SIGNATURE]
    listed = classes.select(*cols, "pool").mapInArrow(work, ", ".join(f"{c} bigint" for c in cols) + ", keys array<bigint>")
    return listed.select(F.explode("keys").alias("key"), "node", F.col("node").alias("root"), "size", *SIGNATURE)


def in_blocks(rows: DataFrame, tile: int, visit: bool) -> DataFrame:
    """rows with a group, and home: whether the row is in its own block. A key of up to `tile` rows is one group; a larger one has
    blocks. With visit, rows that are not of the key's commonest root also visit all other blocks."""
    per = rows.groupBy("key", "root").count().groupBy("key").agg(F.sum("count").alias("n"), F.max(F.struct("count", "root"))["root"].alias("main"))
    large = cut(per.where(F.col("n") > tile).select("key", F.ceil(F.col("n") * 2 / tile).cast("int").alias("blocks"), "main"))
    if large.isEmpty():
        return rows.select(F.col("key").alias("group"), *rows.columns, F.lit(True).alias("home"), F.lit(1).alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int")
    placed = rows.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", own)
    here = F.array("own")
    if visit:
        here = F.when((F.col("blocks") > 1) & (F.col("root") != F.col("main")), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(here)
    placed = placed.withColumn("block", F.explode(here))
    group = F.when(F.col("blocks") > 1, F.xxhash64("key", "block")).otherwise(F.col("key"))
    return placed.select(group.alias("group"), *rows.columns, (F.col("block") == F.col("own")).alias("home"), "blocks")


def similar_pairs(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """The classes and edges of similar_links()."""
    return similar_links(docs, **options)[:2]


def similar_links(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 200, keys: int = 8, tile: int = 1 << 12, limit: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs(doc_id, text) to (classes, edges, links): classes(node, doc_id, t1, t2, ...) has a row per set of shingles, edges(u, v) are
    pairs of nodes with a Jaccard similarity of at least `similarity`, and connect all that the similar pairs found connect. links(u, v)
    connect the same in stars, but for the last round's edges.

    Sets meet under their `keys` smallest shingle hashes (keyed()): two sets of Jaccard similarity s share none of them with a
    probability of (1 - s)**keys. What meets is compared by SimHash of 1024 bits, 256 of them in vertical planes: sets of
    similarity 0.8 differ in 155 bits, deviation 12, so that the radius of 200 loses one in 10**4 of them. Pairs within it are
    verified on their whole texts.

    A row names its `limit` nearest partners. Keys that have more come again, with larger limits and without the pairs whose ends
    are linked by then, until none is left; their rows bring their shingles along, so that the tasks name similar pairs only. So
    a group of near copies sends on its rows, not its pairs, and no pair is passed over.
    """
    classes = classes_of(docs, shingle, 2 * keys)
    cols = ["key", "node", "root", "size", *SIGNATURE]
    rows = cut(keyed(classes, keys, tile))

    def comparer(limit, last):
        def compare(group, key, node, root, size, *rest):
            *parts, home, blocks = rest[: WORDS + 2]
            sig = np.stack(parts, axis=1).view(np.uint64)
            a, b, more = partners(group, root, size, home, sig, similarity, radius, limit, *rest[WORDS + 2 :])
            again = home & (more | ((blocks > 1) & (not last)))
            left = [x[again] for x in (key, node, root, size, *parts)]
            found = [pa.array(np.maximum(node[a], node[b])), pa.array(np.minimum(node[a], node[b])), *[pa.nulls(len(a), pa.int64())] * len(cols)]
            rest = [*[pa.nulls(len(left[0]), pa.int64())] * 2, *map(pa.array, left)]
            return pa.RecordBatch.from_arrays([pa.concat_arrays([x, y]) for x, y in zip(found, rest)], names=["u", "v", *cols])

        return compare

    def verify(batches):
        for batch in batches:
            good, known = [], {}
            for u, v, x, y in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "x", "y"))):
                for node, t in ((u, x), (v, y)):
                    if node not in known:
                        known[node] = shingle_set(t, shingle)
                a, b = known[u], known[v]
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(both >= similarity * (len(a) + len(b) - both) - 1e-9)
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    def short_sets(batches):
        for batch in batches:
            sets = [(shingle_set(t, shingle) >> np.uint64(32)).astype(np.uint32).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "members"])

    edges, tested, stars, first = None, None, None, True
    texts = docs.select("doc_id", *text_hashes("text"), "text")
    while True:
        blocks = in_blocks(rows, tile, visit=not first)
        if not first:
            heads = cut(classes.join(rows.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "t1", "t2"))
            members = texts.join(heads, ["doc_id", "t1", "t2"]).groupBy("node").agg(F.first("text").alias("text")).mapInArrow(short_sets, "node bigint, members binary")
            blocks = blocks.join(cut(members), "node").select(*blocks.columns, "members")
        dealt = blocks.repartition("group").sortWithinPartitions("group", "root", "node")
        found = cut(dealt.mapInArrow(by_key(comparer(limit, not first)), "u bigint, v bigint, " + ", ".join(f"{c} bigint" for c in cols)))
        pairs = found.where("u is not null").select("u", "v").distinct()
        pairs = cut(pairs if tested is None else pairs.join(tested, ["u", "v"], "left_anti"))
        ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        heads = cut(classes.join(ends, "node", "left_semi").select("node", "doc_id", "t1", "t2"))
        whole = texts.join(heads, ["doc_id", "t1", "t2"]).groupBy("node").agg(F.first("text").alias("text"))
        both = pairs.join(whole.select(F.col("node").alias("u"), F.col("text").alias("x")), "u").join(whole.select(F.col("node").alias("v"), F.col("text").alias("y")), "v")
        good = renewed(both.select("u", "v", "x", "y").mapInArrow(verify, "u bigint, v bigint"))
        edges = good if edges is None else edges.union(good)
        links = good if stars is None else stars.union(good)
        rows = found.where("u is null").select(*cols)
        if rows.isEmpty():
            return classes, edges, links
        tested, first, limit = pairs if tested is None else tested.union(pairs), False, limit * (16 if first else 64)
        stars = components(links).where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
        now = stars.select(F.col("u").alias("node"), F.col("v").alias("now"))
        rows = rows.join(now, "node", "left").withColumn("root", F.coalesce("now", "node")).select(*cols)
        several = rows.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
        rows = renewed(rows.join(several, "key", "left_semi"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one row of each group of similar_pairs(), the one with the smallest id (then the smallest text hashes; of equal
    rows any). Rows that share an id but differ in their texts are documents of their own. Rows without an id have no group and
    stay. Texts without words are one group. Other columns, whatever their names, are carried along."""
    slim = columns(docs, doc_id=doc_id, text=text).where("doc_id is not null")
    classes, _, links = similar_links(slim, **options)
    roots = components(links).where("node <> root")
    named = classes.select("node", "doc_id", "t1", "t2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = cut(named.groupBy("root").agg(F.min(F.struct("doc_id", "t1", "t2")).alias("head")).select("head.*"))
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), *text_hashes(text))
    first = Window.partitionBy("doc_id", "t1", "t2").orderBy(F.lit(0))
    named = rows.where("doc_id is not null").join(kept, ["doc_id", "t1", "t2"], "left_semi").withColumn("n", F.row_number().over(first)).where("n = 1")
    return named.select("row.*").union(rows.where("doc_id is null").select("row.*"))
