import datetime as dt
import json

from pyspark.sql import functions as F

from docwatch.functions import text as T
from docwatch.sources import feeds

D = dt.date


def test_normalize_items(spark):
    df = spark.createDataFrame([("12", "/opinion/9/x", "2024-02-30", "Nos. A24A1234, and -s24g0001-", "Smith v. The State of Ohio Inc"), ("x", "/opinion/9/x", "2024-02-03T01:00:00Z", None, None), (None, None, None, "", "123 ab")], "raw string, url string, day string, docket string, name string")
    a, b, c = T.normalize_items(df, "raw", "url", "day", "docket", "name").collect()
    assert (a.item_id, b.item_id, c.item_id) == (12, 9, None)
    assert (a.date, b.date, c.date) == (None, D(2024, 2, 3), None)
    assert a.docket_tokens == ["A24A1234", "S24G0001"] and b.docket_tokens == []
    assert a.party_tokens == ["smith", "ohio"] and c.party_tokens == [] and a.name_key == "smith v the state of ohio inc"


def test_clip_keeps_head_and_tail(spark):
    df = spark.createDataFrame([("a" * 900 + "b" * 2000,), ("short",)], "t string")
    x, y = (r.clipped for r in T.clip_texts(df, "t", 1007, " [...] ").collect())
    assert len(x) == 1007 and x.startswith("a" * 720 + " [...] ") and x.endswith("b" * 280) and y == "short"


def test_lint(spark):
    df = spark.createDataFrame([("Likely seems to be 'a lead', suggests; \u201ccurly one\u201d isn't 'x' \"one thing\" or \"" + "y" * 61 + "\" may  be",), ("unlikely; probable cause",), (None,)], "r string")
    a, b, c = T.lint_reasons(df, "r").collect()
    assert a.hedges == ["likely", "may  be", "seems", "suggests"] and a.quotes == ["a lead", "curly one", "one thing"] and b.hedges == [] == c.hedges


def test_references(spark):
    text = "O.C.G.A. §§ 33-4-6 and 11  U.S.C. § 362, 49 C.F.R. § 395.1; FRCP 12(b)(6). HB  12, Rule 1.7. **Lee v. Cox, 12 U.S. 34 (1999)** **lee v.  Cox, 13 U.S. 1 (2001)** **bold** **O.C.G.A. § 1-1-1, 1 Ga. App. 2**"
    df = spark.createDataFrame([(1, text)], "k int, t string")
    assert sorted(r.reference for r in T.extract_references(df, "k", "t").collect()) == ["11 U.S.C. § 362", "49 C.F.R. § 395.1", "Fed. R. Civ. P. 12(b)(6)", "Ga. R. Prof. Conduct 1.7", "HB 12", "O.C.G.A. § 1-1-1", "O.C.G.A. § 33-4-6"]
    assert [(r.case_key, r.name, r.year, r.cite) for r in T.cited_cases(df, "k", "t").collect()] == [("lee v. cox", "Lee v. Cox", "1999", "12 U.S. 34")]


def test_silence(spark):
    claims = {
        "The bill text does not specify which courts": ["does not specify"], "The Act is silent on fees; it does not say": ["is silent"], "The bill fails to clearly identify the seat": ["fails to clearly identify"],
        "Legislation: terms are not specified": ["not specified"], "statutes do not identify": [], "The statute doesn't state it. The act never makes it": ["doesn't state"],
        "The provided title and description do not specify": [], "the text supplied does not identify": [], "The Act as provided is silent": [], "the act. The summary does not mention it": [], None: [], "": [],
        "The act does not state x and the bill does not mention y": ["does not state", "does not mention"], "The bill " + "x" * 70 + " is silent": [],
    }
    rows = spark.createDataFrame([(k,) for k in claims], "r string")
    assert {r.r: r.silences for r in T.silence_claims(rows, "r").collect()} == claims


def test_calendar_crosses_daylight_saving(spark):
    df = spark.sql("select timestamp'2024-03-10 04:30:00' ts union all select timestamp'2024-03-11 03:59:00' union all select timestamp'2024-03-11 04:00:00'")
    assert [(r.local_date, r.week) for r in T.calendar_keys(df, "ts").orderBy("ts").collect()] == [(D(2024, 3, 9), D(2024, 3, 4)), (D(2024, 3, 10), D(2024, 3, 11)), (D(2024, 3, 11), D(2024, 3, 11))]


def test_vet_urls(spark):
    df = spark.createDataFrame([("http://a.b/c",), ("https://u:p@a.b/",), ("ftp://a.b",), ("https:///x",), (None,)], "u string")
    assert [(r.url_reason, r.safe_url) for r in T.vet_urls(df, "u").collect()] == [(None, "https://a.b/c"), ("credentials", None), ("scheme", None), ("host", None), ("scheme", None)]


def test_stable_keys(spark):
    df = spark.createDataFrame([("New Rule 12",), ("rule 12 (new)",), ("FAO 24 - 1",)], "d string")
    a, b, c = T.stable_keys(df, "d").collect()
    assert a.stable_key == b.stable_key and len(a.stable_key) == 12 and c.opinion_number == "24-1" and (c.sort_key.year, c.sort_key.seq) == (24, 1)


def test_reference_and_issuer_labels(spark):
    df = spark.createDataFrame([(1, 49, 396), (1, 49, 395), (1, 49, 395), (1, 7, None), (2, None, 3)], "k int, t int, p int")
    assert {r.k: r.label for r in T.reference_labels(df, "k", "t", "p").collect()} == {1: "7 CFR; 49 CFR 395, 396"}
    df = spark.createDataFrame([([("a", "Aa"), ("b", "Bb")],), ([("c", "Cc")],), (None,)], "x array<struct<slug:string,name:string>>")
    assert [r.issuer for r in T.issuer_label(df, "x", ["b"]).collect()] == ["b", "Cc", None]


def test_assemble_items(spark):
    schema = "dockets array<string>, docket string, disposition string, areas array<string>, holdings array<struct<areas:array<string>,synopsis:string,why:string>>"
    df = spark.createDataFrame([(["", " A1 "], "B", "AFFIRMED", ["x", "y"], [(["z", "x"], "s", "w"), (["q"], "", "w")]), (None, " B ", " ", None, None)], schema)
    a, b = T.assemble_items(df).collect()
    assert a.dockets == ["A1"] and a.disposition == "affirmed" and a.all_areas == ["x", "y", "z"] and len(a.holdings) == 1
    assert b.dockets == ["B"] and b.disposition is None and b.all_areas == []


def test_html_to_text(spark):
    df = spark.createDataFrame([("<html><style>p{}</style><script>var t='</p>';</script><p>Tom &amp; J&eacute;r&ocirc;me</p><p>two<br>lines  x</p></html>",), (None,)], "h string")
    a, b = T.html_to_text(df, "h").collect()
    assert a.page_text == "Tom & Jérôme\ntwo\nlines x" and b.page_text == ""


def test_caption_facts(spark):
    r = T.caption_facts(spark.createDataFrame([("A24A1234. Decided: March 4, 2024. See 12 Ga. App. 34",)], "t string"), "t").first()
    assert r.caption_dockets == ["A24A1234"] and r.decided == D(2024, 3, 4) and r.has_citation


def test_feed(spark, tmp_path):
    entry = '<entry><title>{t}</title><link rel="alternate" href="{u}"/><link rel="enclosure" type="application/pdf" href="p.pdf"/>{d}<summary>&lt;b&gt;Hi&lt;/b&gt; docket no. A1-2</summary></entry>'
    body = "".join([entry.format(t="A v. B", u="https://www.x.org/opinion/12/a/", d="<published>2024-01-02T00:00:00Z</published>"), entry.format(t="C", u="https://x.org/other/", d=""), entry.format(t="D", u="https://x.org/opinion/13/", d="<updated>2024-01-05</updated>"), entry.format(t="E", u="https://x.org.evil.com/opinion/14/", d="")])
    (tmp_path / "f.xml").write_text(f'<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom">{body}</feed>')
    rows = feeds.read_feed(spark, str(tmp_path / "f.xml"), "ga", "x.org").orderBy("item_id").collect()
    assert [(r.item_id, r.date, r.pdf_url, r.docket, r.snippet) for r in rows[:2]] == [(12, D(2024, 1, 2), "p.pdf", "A1-2", "Hi docket no. A1-2"), (13, D(2024, 1, 5), "p.pdf", "A1-2", "Hi docket no. A1-2")]
    assert [(r.item_id, r.path) for r in rows] == [(12, "/opinion/12/a/"), (13, "/opinion/13/"), (14, "https://x.org.evil.com/opinion/14/")]  # a look-alike keeps its url


def test_feeds_with_problems(spark, tmp_path):
    entry = '<entry><title>t</title><link rel="alternate" href="https://x.org/opinion/{k}/"/></entry>'
    feed = lambda k: f"<feed>{entry.format(k=k)}</feed>"
    files = {"good": feed(1).encode(), "dtd": b'<!DOCTYPE feed [<!ENTITY a "b">]>' + feed(2).encode(), "wide": ("<!DOCTYPE feed>" + feed(3)).encode("utf-16"), "latin": feed(4).replace("t</title", "\xe9</title").encode("latin-1"),
             "broken": feed(5)[:-10].encode(), "large": feed(6).encode() + b" " * 5000, "empty": b"", "none": b"<feed></feed>", "bom": b"\xef\xbb\xbf" + feed(7).encode()}
    for name, content in files.items():
        (tmp_path / f"{name}.xml").write_bytes(content)
    got = {r.path.rsplit("/", 1)[1][:-4]: r.problem for r in feeds.feed_documents(spark, str(tmp_path), 4000).collect()}
    assert got == {"good": None, "dtd": "dtd", "wide": "dtd", "latin": "encoding", "broken": "malformed", "large": "size", "none": None, "bom": None}
    assert sorted(r.item_id for r in feeds.read_feed(spark, str(tmp_path), "s", "x.org", 4000).collect()) == [1, 7]


def test_payloads(spark, tmp_path):
    hits = spark.createDataFrame([(1, "n", "c", "2024-01-01", " a  b ", [(5, " ", "http://d/x")]), (None, "n", "c", "", "", None), (2, "n", "c", "bad", None, None)], "cluster_id long, caseName string, court_id string, dateFiled string, snippet string, opinions array<struct<id:long,local_path:string,download_url:string>>")
    a, b = feeds.flatten_search_hits(hits).collect()
    assert (a.pdf_url, a.snippet, a.opinion_ids, b.date, b.opinion_ids) == ("http://d/x", "a b", [5], None, [])
    payload = json.dumps({"masterlist": {"session": {"session_id": 1}, "0": {"bill_id": 7, "number": "HB1"}, "1": {"number": "x"}}})
    rows = feeds.flatten_master_list(spark.createDataFrame([(payload,)], "p string"), "p", "bill_id LONG, number STRING").collect()
    assert [(r.bill_id, r.number) for r in rows] == [(7, "HB1")]
    (tmp_path / "l.jsonl").write_text('{"id": 1}\n\nnot json\n{"id": 2}\n')
    good, counts = feeds.read_log(spark, str(tmp_path / "l.jsonl"), "id LONG")
    assert sorted(r.id for r in good.collect()) == [1, 2] and counts.get == {"lines": 3, "good": 2, "corrupt": 1}
    report = spark.createDataFrame([({"p1": [("http://a", 404), ("mailto:x", 0)]}, {"p2": [("http://a", 500), ("http://b", 500)]})], "error_map map<string,array<struct<url:string,status:int>>>, fail_map map<string,array<struct<url:string,status:int>>>")
    assert sorted(map(tuple, feeds.flatten_link_report(report, ["error_map", "fail_map"]).collect())) == [("http://a", 404, "p1"), ("http://b", 500, "p2")]


def test_release_index(spark):
    html = "<h3>March 4, 2024</h3><ul><li>A24A0001, A24A0002. X v. Y</li><li>no docket</li></ul><p><h3>April 1, 2024</h3><li>A24A0001. again</li>"
    index = feeds.release_index(spark.createDataFrame([(1, html)], "page int, html string"), "page", "html")
    assert index.count() == 3
    assert sorted((r.docket, r.released) for r in feeds.as_release_dates(index, "page").collect()) == [("A24A0001", D(2024, 4, 1)), ("A24A0002", D(2024, 3, 4))]


def test_write_slices(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], 5), (2, ["a"], 7)], "item_id int, areas array<string>, date int")
    rows, counts = feeds.slices(df, "areas", spark.createDataFrame([("a",), ("b",), ("c",)], "area string"), [F.desc("date")])
    feeds.write_slices(rows, str(tmp_path / "s"))
    assert {r.area: r.n for r in counts.collect()} == {"a": 2, "b": 1, "c": 0} and spark.read.parquet(str(tmp_path / "s/area=a")).count() == 2
    feeds.write_slices(rows, str(tmp_path / "s"), counts, str(tmp_path / "index"))
    assert {r.area: r.n for r in spark.read.parquet(str(tmp_path / "index")).collect()} == {"a": 2, "b": 1, "c": 0}
