"""Personal data: patterns, then terms that reveal a protected value.

Patterns give base spans: e-mail, IP, card and phone, whose values are the protected entities. Words near an entity
are its context. Document counts over the whole corpus give the pointwise mutual information of term and entity,
PMI = log2(N n(t,e) / (n(t) n(e))), and the entity's own information, IC = log2(N / n(e)). A term that occurs by the
entity in at least min_texts different texts and discloses PMI / IC >= generalise of it becomes a span of its own:
it is generalised to its word class, or removed at PMI / IC >= remove. Common words disclose little and stay.

Term counts are exact: all documents count, but a fixed-size bit filter made from the candidate terms drops most
other terms before the shuffle (a false positive only ships a row more). mark() gives, and sanitise() takes out, every
occurrence of a revealing term, in whatever document it stands.

Defined cases: null text counts as empty; very long texts and words are read whole; spans depend on the text alone, so equal
texts get equal spans and repeated rows results of their own; spans that start together are listed in the order of KINDS;
null ids are kept; an empty table gives an empty result; other columns, whatever their names, are ignored by mark() and
kept by sanitise().
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from docwatch.llm.common import columns, cut, plain

#: In the order in which spans that start together are listed.
KINDS = ("email", "ip", "card", "phone", "term")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W_]+")
#: All four kinds of base spans need a digit or @.
SUSPECT = re.compile("[0-9@]")
#: ASCII letters in lower case and digits are parts of terms, other ASCII characters are not, further bytes are left to TERM.
TABLE = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))
SPANS = "array<struct<start:int,kind:int,end:int>>"


def emails(text: str):
    """Leftmost matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from the @ so that long words cost no more."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def ips(text: str):
    """Leftmost runs of four dotted numbers, each at most 255."""
    for m in DOTTED.finditer(text):
        parts, at = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield at, end
            at = end + 1


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def cards(text: str):
    for m in CARD.finditer(text):
        digits = re.sub(r"[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str):
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, by start, then kind."""
    if not SUSPECT.search(text):
        return []
    return sorted((a, k, b) for k, find in enumerate((emails, ips, cards, phones)) for a, b in find(text))


def terms_of(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, bool]]:
    """(start, end, free) of every term of a text; free if it overlaps no base span."""
    out, ends, k = [], 0, 0
    for m in TERM.finditer(text):
        while k < len(spans) and spans[k][0] < m.end():
            ends = max(ends, spans[k][2])
            k += 1
        out.append((m.start(), m.end(), ends <= m.start()))
    return out


def contexts(text: str, spans: list[tuple[int, int, int]], reach: int, least: int) -> list[tuple[str, str, int, int]]:
    """(entity, term, start, end): of the `reach` terms on either side of each span those that overlap no base span and have `least`
    characters. Terms are whole, however long they are or wherever the text breaks around them."""
    out = []
    terms = terms_of(text, spans) if spans else []
    starts, ends = [t[0] for t in terms], [t[1] for t in terms]
    for start, kind, end in spans:
        entity = f"{KINDS[kind]}:{text[start:end]}"
        left, right = bisect_right(ends, start), bisect_left(starts, end)
        for a, b, free in terms[max(0, left - reach) : left] + terms[right : right + reach]:
            if free and b - a >= least:
                out.append((entity, text[a:b].lower(), a, b))
    return out


def detect(docs: DataFrame, reach: int = 8, least: int = 4) -> DataFrame:
    """docs(text) to (key, near) for the texts with a term near a base span; key identifies the text."""

    def work(batches):
        context = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string())]))
        for batch in batches:
            keys, near = [], []
            for text in batch.column(0).to_pylist():
                if found := contexts(text, base_spans(text), reach, least):
                    near.append([dict(zip(("entity", "term"), c)) for c in found])
                    keys.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(near, context)], names=["key", "near"])

    return docs.select("text").where(F.col("text").rlike(SUSPECT.pattern)).mapInArrow(work, "key string, near array<struct<entity:string,term:string>>")


def bit_filter(terms: DataFrame, bits: int) -> Broadcast:
    """2**bits bits: those of the CRC-32 of terms(term). Tasks build bitmaps of 2**15 bits each, which are merged before and after
    the shuffle; 2**(bits - 15) of them at most reach the driver, whatever the number of terms."""
    slot = F.crc32(F.col("term").cast("binary")).bitwiseAND(F.lit((1 << bits) - 1)) + 1  # Spark numbers bits from 1
    maps = terms.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    mask = np.zeros((max(1, 1 << bits >> 15), 1 << 15), bool)
    for b, found in maps.collect():
        mask[b - 1] = np.unpackbits(np.frombuffer(found, np.uint8), bitorder="little")
    return terms.sparkSession.sparkContext.broadcast(np.packbits(mask.reshape(-1)[: 1 << bits]).tobytes())


class Passing:
    """The distinct terms of texts, in lower case and UTF-8, that a bit filter lets through.

    A table cuts at ASCII characters, words with other characters meet the pattern. Words without a passing term are remembered,
    so that frequent ones are judged once per task; what is remembered is bounded in number and length."""

    def __init__(self, mask: bytes):
        self.mask, self.low, self.clean = mask, len(mask) * 8 - 1, set()

    def __call__(self, text: str) -> set[bytes]:
        found = set()
        for word in set(text.encode("utf-8", "surrogatepass").translate(TABLE).split()) - self.clean:
            terms = [word] if word.isascii() else [w.lower().encode("utf-8") for w in TERM.findall(word.decode("utf-8", "surrogatepass"))]
            passing = [t for t in terms if self.mask[(slot := zlib.crc32(t) & self.low) >> 3] & (128 >> (slot & 7))]
            found.update(passing)
            if not passing and len(word) <= 64:
                self.clean.add(word)
        if len(self.clean) > 500_000:
            self.clean.clear()
        return found


def document_counts(docs: DataFrame, terms: DataFrame, bits: int = 20) -> DataFrame:
    """(term, n_t): in how many rows of docs(text) a term occurs; complete for terms(term), others may come along."""
    shared = bit_filter(terms, bits)

    def work(batches):
        counts: dict[bytes, int] = {}
        passing = Passing(shared.value)

        def flush():
            terms = pa.array(list(counts), pa.binary()).cast(pa.string())
            out = pa.RecordBatch.from_arrays([terms, pa.array(list(counts.values()), pa.int64())], names=["term", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for term in passing(text or ""):
                    counts[term] = counts.get(term, 0) + 1
            if len(counts) > 100_000:
                yield flush()
        yield flush()

    return docs.select("text").mapInArrow(work, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))


EMPTY = "array<struct<start:int,end:int,remove:boolean>>"


def revealing_terms(slim: DataFrame, generalise: float, remove: float, min_texts: int) -> DataFrame:
    """(term, remove): a row per entity that a term of slim(text) discloses."""
    total = slim.count()
    # a text once, with the number of documents that carry it
    carried = cut(detect(slim).groupBy("key").agg(F.count("*").alias("copies"), F.first("near").alias("near")))
    linked = carried.select("key", "copies", F.explode("near").alias("c")).select("key", "copies", "c.entity", "c.term").distinct()
    pairs = cut(linked.groupBy("entity", "term").agg(F.sum("copies").alias("n_et"), F.count("*").alias("texts")).where(F.col("texts") >= min_texts))
    if pairs.isEmpty():
        return pairs.select("term", F.lit(False).alias("remove"))
    entities = linked.select("key", "copies", "entity").distinct().groupBy("entity").agg(F.sum("copies").alias("n_e"))
    terms = document_counts(slim, pairs.select("term").distinct())
    pairs = pairs.join(entities, "entity").join(terms, "term")
    pmi = F.log2(F.lit(float(total)) * F.col("n_et") / (F.col("n_t") * F.col("n_e")))
    content = F.log2(F.lit(float(total)) / F.col("n_e"))
    disclosed = F.when(content > 0, pmi / content).otherwise(F.lit(0.0))
    return pairs.withColumn("disclosed", disclosed).where(F.col("disclosed") >= generalise).select("term", (F.col("disclosed") >= remove).alias("remove"))


def occurrences(text: str, spans: list[tuple[int, int, int]], terms: set[bytes]) -> list[tuple[str, int, int]]:
    """(term, start, end) of every word in terms that overlaps no base span."""
    if not terms:
        return []
    words = {t.decode("utf-8", "surrogatepass") for t in terms}
    return [(word, a, b) for a, b, free in terms_of(text, spans) if free and (word := text[a:b].lower()) in words]


def mark(docs: DataFrame, generalise: float = 0.8, remove: float = 0.9, min_texts: int = 2, doc_id: str = "doc_id", text: str = "text", bits: int = 24) -> tuple[DataFrame, DataFrame, Broadcast]:
    """(rows, texts, mask): rows(doc_id, base, terms) has a row per row of docs, texts(key, base, terms) one per text with a span or
    a term that the bit filter mask lets through. terms holds (start, end, remove) for every occurrence of a term that reveals some
    entity, whether the entity is near, elsewhere in the text or not in it; key is the text's SHA-256."""
    slim = columns(docs, doc_id=doc_id, text=text)
    kind = slim.schema["doc_id"].dataType.simpleString()
    revealing = revealing_terms(slim, generalise, remove, min_texts)
    terms = cut(revealing.groupBy("term").agg(F.max("remove").alias("remove")))
    shared = bit_filter(terms, bits)

    def work(batches):
        span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        spot = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        passing = Passing(shared.value)
        for batch in batches:
            keys, bases, spots = [], [], []
            for t in batch.column("text").to_pylist():
                spans = base_spans(t or "")
                found = passing(t or "")
                keys.append(hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() if spans or found else None)
                bases.append([dict(zip(("start", "kind", "end"), s)) for s in spans])
                spots.append([dict(zip(("term", "start", "end"), s)) for s in occurrences(t, spans, found)] if spans or found else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.string()), pa.array(bases, span), pa.array(spots, spot)], names=["doc_id", "key", "base", "spots"])

    seen = cut(slim.mapInArrow(work, f"doc_id {kind}, key string, base {SPANS}, spots array<struct<term:string,start:int,end:int>>"))
    carried = cut(seen.where("key is not null").groupBy("key").agg(F.first("base").alias("base"), F.first("spots").alias("spots")))
    hits = carried.select("key", F.explode("spots").alias("s")).select("key", "s.*").join(terms, "term")
    extra = hits.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "remove"))).alias("terms"))
    empty = F.array().cast(EMPTY)
    texts = cut(carried.join(extra, "key", "left").select("key", "base", F.coalesce("terms", empty).alias("terms")))
    marked = seen.where("key is not null").select("doc_id", "key").join(texts, "key").select("doc_id", "base", "terms")
    return seen.where("key is null").select("doc_id", "base", empty.alias("terms")).union(marked), texts, shared


def sanitise(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """docs with base spans replaced by their kind in brackets, revealing terms generalised ([Word], [word], [number]) or removed; where spans overlap the first, then longest, counts."""
    _, texts, shared = mark(docs, doc_id=doc_id, text=text, **options)
    spans = texts.select("key", F.struct("base", "terms").alias("found"))
    rows, where = plain(docs), docs.columns.index(text)
    names = rows.columns

    def work(batches):
        for batch in batches:
            out = []
            for t, marked in zip(batch.column(where).to_pylist(), batch.column(len(names)).to_pylist()):
                marks = [(s["start"], -s["end"], f"[{KINDS[s['kind']].upper()}]") for s in marked["base"] or ()]
                for s in marked["terms"] or ():
                    word = t[s["start"] : s["end"]]
                    marks.append((s["start"], -s["end"], "" if s["remove"] else "[number]" if word.isdigit() else "[Word]" if word[0].isupper() else "[word]"))
                done, parts = 0, []
                for start, end, mark in sorted(marks):
                    if start >= done:
                        parts += [t[done:start], mark]
                        done = -end
                out.append("".join(parts) + t[done:])
            arrays = list(batch.columns[: len(names)])
            arrays[where] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    def touched(batches):
        passing = Passing(shared.value)
        for batch in batches:
            texts = batch.column(where).to_pylist()
            yield batch.append_column("dirty", pa.array([bool(base_spans(t or "") or passing(t or "")) for t in texts], pa.bool_()))

    seen = rows.mapInArrow(touched, StructType([*rows.schema, StructField("dirty", BooleanType())]))
    joined = seen.where("dirty").withColumn("key", F.sha2(names[where], 256)).join(spans, "key").select(*names, "found")
    return seen.where("not dirty").select(*names).union(joined.mapInArrow(work, rows.schema)).toDF(*docs.columns)
