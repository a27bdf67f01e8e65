import base64
import gzip
import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strider.llm import html, urls, warc

ARTICLE = "<p>A long paragraph, with much text, and punctuation. It goes on, and on, here.</p><p>Short.</p><p>Another <b>long</b> one&nbsp;of text,<br>and &lt;more&gt; text. Still, it goes on.</p>"
WANT = "A long paragraph, with much text, and punctuation. It goes on, and on, here.\n\nShort.\n\nAnother long one of text, and <more> text. Still, it goes on."


@pytest.mark.parametrize("page,want", [
    (f"<nav><a href='/'>Home</a></nav><article>{ARTICLE}</article><footer>f, g. h</footer>", WANT),
    (f"<div id='content'>{ARTICLE}</div><div class='sidebar'><p>Some, other text. Rather long, it is, and so on, to be sure.</p></div>", WANT),
    (f"<article>{ARTICLE}<section class='comments'><p>I think, this is great. Really, it is. Long comment, too.</p></section></article>", WANT),
    (f"<article><h1>Head</h1>{ARTICLE}<div class='ad'>Buy, now. Cheap.</div><form><p>Sign up, now.</p></form></article><aside>More, here.</aside>", "Head\n\n" + WANT),
    (f"<article>{ARTICLE}</article><article class='comment'><p>Nice, text. Very good, indeed.</p></article>", WANT),
    (f"<div class=with-sidebar><main>{ARTICLE}</main></div><script>var a = '<p>no</p>';</script><!-- <p>no</p> -->", WANT),
    (f"<body><div class='cookie-notice'>We use cookies, a lot.</div><article><header><h1>H</h1></header>{ARTICLE}", "H\n\n" + WANT),
    (f"<div><ul><li><a href='/a'>One</a></li><li><a href='/b'>Two</a></li></ul>{ARTICLE}</div>", WANT),
    ("<article><p><b>Bold.<p>Next</article>", "Bold.\n\nNext"),
    ("<article>a<ul><li>one<li>two</ul>b</article>", "a\n\none\n\ntwo\n\nb"),
    ("just text", "just text"), ("", ""), (None, ""), ("<p></p><br>", ""), ("<p>a < b & c</p>", "a < b & c"), ("<p title=don't>x's</p>", "x's"),
])
def test_extraction(page, want):
    assert html.extract(page) == want


LONG, REST = "A long text, with much in it. It goes on, and on. " * 14, "The rest of it, not as long. It ends, here. " * 7


@pytest.mark.parametrize("page", [
    f"<div id=c><div>{LONG}</div><div>{REST}</div></div>",
    f"<section><h2>One</h2><p>{LONG}</p></section><section><h2>Two</h2><p>{REST}</p></section>",
    f"<dl><dd>{LONG}</dd><dd>{REST}</dd></dl>", f"<div><figure>{LONG}</figure><p>{REST}</p></div>",
])
def test_uneven_parts_are_all_kept(page):
    want = [" ".join(x.split()) for x in (LONG, REST)]
    got = html.extract(page).split("\n\n")
    assert [x for x in got if x not in ("One", "Two")] == want and ("One" in got) == ("Two" in got) == ("<h2>" in page)


@pytest.mark.parametrize("page,want", [
    (f"<main><h1>Head</h1><p>{LONG}</p><p>{REST}</p><article>A teaser.</article></main>", ["Head", LONG, REST, "A teaser."]),
    (f"<article><p>{LONG}</p></article><div><h2>More</h2><p>{LONG}</p><p>{REST}</p></div>", [LONG, "More", LONG, REST]),
    (f"<div>Site</div><article><p>{LONG}</p><p>Short.</p><p>{REST}</p></article><div>2024 Someone</div>", [LONG, "Short.", REST]),
])
def test_scores_choose_beside_named_articles(page, want):
    assert html.extract(page).split("\n\n") == [" ".join(x.split()) for x in want]


PROSE = "It was, as she said, a long day; nobody had asked why. The boats came in late, heavy with fish, and the market stayed open. "


@pytest.mark.parametrize("page,want", [
    # parts of an article whose names also name boilerplate
    (f"<article><p>{PROSE * 3}</p><section id='discussion'><h2>Discussion</h2><p>{PROSE * 2}</p></section></article>", [PROSE * 3, "Discussion", PROSE * 2]),
    (f"<article><p>{PROSE * 3}</p><div class='legal-analysis'><p>{PROSE}</p></div><p>{PROSE}</p></article>", [PROSE * 3, PROSE, PROSE]),
    (f"<article><p>{PROSE * 3}</p><section id='related-work'><p>{PROSE}</p></section><div class='notice'>{PROSE}</div></article>", [PROSE * 3, PROSE, PROSE]),
    # no telling names at all
    (f"<div>Site</div><div><a href=1>One</a> <a href=2>Two</a></div><div><h2>Head</h2><p>{PROSE * 2}</p><p>Short.</p><p>{PROSE * 3}</p><ul><li>one<li>two<li>three</ul></div><div>2024 Someone</div>", ["Head", PROSE * 2, "Short.", PROSE * 3, "one", "two", "three"]),
    (f"<table><tr><td><a href=1>One</a><br><a href=2>Two</a></td><td><p>{PROSE * 2}</p><p>{PROSE}</p></td></tr></table>", [PROSE * 2, PROSE]),
    # menus and comments inside articles, however deep
    (f"<article><p>{PROSE * 2}</p>{'<div>' * 600}<nav><p>Some, other; text.</p></nav>{'</div>' * 600}<p>{PROSE}</p></article>", [PROSE * 2, PROSE]),
    (f"<article><p>{PROSE * 2}</p><div class='comments'>{'<div>' * 600}<p>{PROSE}</p></div></article>", [PROSE * 2]),
    (f"<article><p>{PROSE}</p></article><form><p>{PROSE * 3}</p></form><footer><p>{PROSE * 9}</p></footer>", [PROSE]),
    (f"<form id=aspnet><div><p>{PROSE}</p><p>{PROSE}</p></div></form>", [PROSE, PROSE]),
    ("<nav><a href=1>One</a></nav><article></article><footer>(c) Someone, 2024</footer>", []),
])
def test_scores_and_names(page, want):
    assert html.extract(page).split("\n\n") == ([" ".join(x.split()) for x in want] or [""])


def flat(found, sigma=1.0):
    return {b.node.path: 1.0 for b in found}


def test_scores_decide(monkeypatch):
    pages = [f"<div>Site</div><div><a href=1>One</a></div><div><p>{PROSE * 2}</p><p>{PROSE}</p></div><div>2024 Someone</div>", f"<nav><a href='/'>Home</a></nav><article>{ARTICLE}</article>"]
    before = [html.extract(p) for p in pages]
    monkeypatch.setattr(html, "path_scores", flat)
    assert all(html.extract(p) != b for p, b in zip(pages, before))


def test_path_scores_against_plain_sums():
    """Fused ratios of a page, computed from its text alone."""
    found = html.blocks("<div><p>Ab, cd. Ef</p><p>Gh!</p></div><ul><li><a href=1>Link</a> ij</li></ul>")
    fused, plain = html.ratios(found)
    p, li = found[0].node.path, found[2].node.path
    assert fused[p] == pytest.approx(((10 + 3) / 2 * (1 + 3 / 2)) ** 0.5 * (13 / 16) ** 0.5) and plain[p] == 1
    assert fused[li] == pytest.approx(3**0.5 * (3 / 16) ** 0.5) and plain[li] == pytest.approx(3 / 7)


def test_hostile_markup_is_linear():
    import time

    began = time.time()
    for bad in ("<a " * 50_000, "<p title='" * 20_000, "<div>" * 20_000 + "x", "</p>" * 50_000, "<" * 100_000, "<!--" * 20_000, "<div>x" * 20_000, "<a x='" * 20_000 + ">", "<b>" * 50_000 + "x"):
        html.extract(bad)
    assert time.time() - began < 30


def test_extracted_table(spark):
    df = spark.createDataFrame([(1, "u", f"<article>{ARTICLE}</article>", 5), (2, None, None, 6), (2, None, None, 6)], "page_id long, url string, html string, text int")
    got = sorted((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in html.extracted(df).collect())
    assert got == [(1, "u", WANT, len(WANT)), (2, None, "", 0), (2, None, "", 0)]
    assert html.extracted(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
@pytest.mark.parametrize("change", [lambda h: h, lambda h: h.replace("<article>", "<div>").replace("</article>", "</div>")])
def test_generated_pages(spark, monkeypatch, change):
    """Against the text between the generator's article tags, with and without these; and never without scores."""
    import html as entities

    def want(h):
        h = re.sub(r"</?(?:h1|p)>", "\0", h[h.index("<article>") + 9 : h.index("</article>")])
        return "\n\n".join(x for x in (" ".join(entities.unescape(b).split()) for b in re.sub(r"<[^>]*>", " ", h).split("\0")) if x)

    rows = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    assert [html.extract(change(h)) for h in rows] == [want(h) for h in rows]
    monkeypatch.setattr(html, "path_scores", flat)
    assert not any(html.extract(change(h)) == want(h) for h in rows)


# ---- WARC


def expected(rows):
    latest = {}
    for i, _, h in rows:
        latest[h or ""] = i if latest.get(h or "") is None else max(latest[h or ""], i if i is not None else -(10**9))
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        first = latest[h or ""]
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == first else "revisit", None if i == first else first, None))
    return sorted(out, key=str)


@pytest.mark.parametrize("segment", [16_384, 60])
def test_archives_round_trip(spark, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(warc, "SEGMENT", segment)
    monkeypatch.setattr(warc.records, "__defaults__", (segment,))
    big = "é\r\n\r\nWARC/1.1\r\n" * 9000
    rows = [(1, "http://a/", "x"), (2, None, "x"), (3, "u\r\nX: y", big), (4, "", None), (5, "u", ""), (6, "u", big), (6, "u", big), (7, "u", "\U0001f600" * 500), (7, "u", "other"), (8, "u", "0\r\n\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_copy", F.lit(1)).repartition(3)
    warc.archive(df, f"{tmp_path}/w")
    got = [tuple(r) for r in warc.restore(spark, f"{tmp_path}/w").collect()]
    assert sorted(got, key=str) == expected(rows)


def test_broken_records_are_named():
    parts = []
    sha = hashlib.sha1(b"text " * 50).hexdigest()
    for k, record in enumerate(warc.records(1, "u", "text " * 50, sha, 1, None, 100), 1):
        ((fields, block),) = warc.parse(record)
        parts.append((fields.get("warc-segment-origin-id", fields["warc-record-id"]), int(fields["warc-segment-number"]), int(fields.get("warc-segment-total-length", 0)) or None, 1, "response", None, fields.get("warc-payload-digest", "sha1:")[5:], 250, block))
    assert len(parts) > 2 and len({p[0] for p in parts}) == 1
    assert warc.whole(parts[::-1])[5] is None
    assert warc.whole(parts[:1] + parts[2:])[5] == "missing segment"
    assert warc.whole(parts[:-1])[5] in ("wrong total length", "broken framing")
    assert warc.whole([(*parts[0][:8], parts[0][8].replace(b"text ", b"tExt ", 1)), *parts[1:]])[5] == "wrong digest"


@pytest.mark.parametrize("segment", [16_384, 60])
def test_payloads_are_given_back(spark, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(warc.records, "__defaults__", (segment,))
    rows = [(1, "http://a/", "x"), (2, None, "x"), (3, "u", "é\r\n\r\nWARC/1.1\r\n" * 2000), (4, "", None), (5, "u", ""), (6, "u", "é\r\n\r\nWARC/1.1\r\n" * 2000)]
    warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"), f"{tmp_path}/w")
    got = {r["page_id"]: (bytes(r["payload"]), r["record_type"], r["problem"]) for r in warc.payloads(spark, f"{tmp_path}/w").collect()}
    assert got == {i: ((h or "").encode(), "revisit" if i in (1, 3, 4) else "response", None) for i, _, h in rows}


def test_revisits_are_checked_against_their_response(spark, tmp_path):
    sha = lambda t: hashlib.sha1(t).hexdigest()
    wrong = warc.records(5, "u", "broken", sha(b"broken"), 1, None)[0].replace(b"broken", b"brOken")
    found = [*warc.records(1, "u", "text", sha(b"text"), 1, None), *warc.records(2, "u", "text", sha(b"text"), 1, 1), *warc.records(3, "u", "other", sha(b"text"), 1, 1), *warc.records(4, "u", "text", sha(b"text"), 1, 99), wrong, *warc.records(6, "u", "broken", sha(b"broken"), 1, 5)]
    found[2] = found[2].replace(warc.base32(sha(b"text")).encode(), warc.base32(sha(b"other")).encode())
    found.append(found[1].replace(b"X-Page-Id: 2", b"X-Page-Id: 7").replace(b"X-Payload-Length: 4", b"X-Payload-Length: 400"))
    (tmp_path / "w").mkdir()
    # an archive of another writer: some records in one member, others in their own
    (tmp_path / "w/a.warc.gz").write_bytes(gzip.compress(b"".join(found[:3])) + b"".join(gzip.compress(r) for r in found[3:]))
    got = {r["page_id"]: (r["payload_bytes"], r["problem"]) for r in warc.restore(spark, f"{tmp_path}/w").collect()}
    assert got == {1: (4, None), 2: (4, None), 3: (5, "wrong digest"), 4: (4, "missing response"), 5: (6, "wrong digest"), 6: (6, "broken response"), 7: (4, None)}


def test_archives_are_plain_gzip_files_that_split(spark, tmp_path):
    """Every record is a member of its own that any reader of gzip finds; Spark reads a file in parts."""
    rnd = random.Random(3)
    rows = [(i, f"http://h/{i}", "".join(rnd.choices("abc <>é\u2028\r\n\0", k=rnd.choice([0, 10, 3000, 60_000])))) for i in range(300)] + [(900, "u" * 70_000, "x" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.archive(df, f"{tmp_path}/w")
    data = b"".join((tmp_path / "w" / x).read_bytes() for x in os.listdir(tmp_path / "w") if x.startswith("part-"))
    found = [f for f, _ in warc.parse(gzip.decompress(data))]
    assert sum(f["warc-type"] == "response" for f in found) == len({h for _, _, h in rows})
    assert [len(list(warc.parse(m))) for m in warc.members(data)] == [1] * len(found)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
        assert warc.found_records(spark, f"{tmp_path}/w").rdd.getNumPartitions() > 5
        got = sorted((tuple(r) for r in warc.restore(spark, f"{tmp_path}/w").collect()), key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == expected(rows)
    broken = bytearray(data)
    broken[len(data) // 2] ^= 4
    (tmp_path / "b").mkdir()
    (tmp_path / "b/part-0.txt").write_bytes(bytes(broken))
    with pytest.raises(Exception):
        warc.found_records(spark, f"{tmp_path}/b").collect()


def test_empty_archive(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.archive(df, f"{tmp_path}/w")
    assert warc.restore(spark, f"{tmp_path}/w").count() == 0


# ---- URLs

URLS = {
    "http://a.net/x": ("a.net", "/x", "net/", "block"), "http://EXAMPLE.net/en/?q": ("example.net", "/en/", "example.net/en/", "allow"), "https://www.example.net/en/a#b": ("www.example.net", "/en/a", "example.net/en/", "allow"),
    "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"), "http://x.example.com/de/": ("x.example.com", "/de/", "example.com/de/", "block"), "http://y.org/fr/1": ("y.org", "/fr/1", "org/fr/", "allow"),
    "http://a.net": ("a.net", "", None, "block"), "nothing": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://": ("", "", None, "allow"), "x://h?a/b": ("h", "", None, "allow"), "x://İ.ORG/p://q": ("İ.org", "/p://q", None, "allow"),
}


def test_rules_and_parsing(spark):
    df = spark.createDataFrame([(i, u, "") for i, u in enumerate(URLS)], "page_id long, url string, html string")
    got = {r["page_id"]: tuple(r[c] for c in ("host", "path", "rule", "verdict")) for r in urls.judge(df).collect()}
    assert [got[i] for i in range(len(URLS))] == list(URLS.values())


def test_trust_and_distrust_follow_links(spark):
    pages = [(1, "http://good.org/fr/", '<a href="http://friend.com/x">'), (2, "http://friend.com/", '<A HREF=http://far.com/ >'), (3, "http://far.com/", ""), (4, "http://shill.com/", "<a href='http://bad.net/p'>"), (5, "http://bad.net/p", '<a href="http://victim.com/">'), (6, "http://victim.com/", '<a href="/relative">'), (7, None, None)]
    rows = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    a = urls.DAMPING
    assert rows[2]["trust"] == pytest.approx((1 - a) * a) and rows[3]["trust"] == pytest.approx((1 - a) * a * a)
    assert rows[4]["distrust"] == pytest.approx((1 - a) * a) and rows[4]["verdict"] == "block"
    assert (rows[6]["distrust"], rows[6]["verdict"]) == (0, "allow") and rows[5]["verdict"] == "block" and rows[2]["verdict"] == "allow"


def ranks(seed, edges, a):
    """Personalised PageRank by solving its equations."""
    hosts = sorted({*seed, *(x for e in edges for x in e)})
    place = {h: i for i, h in enumerate(hosts)}
    m = np.zeros((len(hosts), len(hosts)))
    for x, y in edges:
        m[place[x], place[y]] = 1 / sum(e[0] == x for e in edges)
    s = np.array([seed.get(h, 0.0) for h in hosts])
    return dict(zip(hosts, np.linalg.solve(np.eye(len(hosts)) - a * m.T, (1 - a) * s)))


def test_ranks_against_linear_algebra(spark):
    """Cycles, a hub, hosts without links, links of all kinds; both walks, spread to the last."""
    rnd = random.Random(5)
    hosts = [f"h{i}.com" for i in range(30)] + ["good.org", "bad.net", "worse.net"]
    edges = {(rnd.choice(hosts), rnd.choice(hosts)) for _ in range(80)} | {("hub.com", h) for h in hosts} | {("h1.com", "h2.com"), ("h2.com", "h1.com")}
    edges = {e for e in edges if e[0] != e[1]}
    form = ['<a href="http://{}/x">', "<A class=b HREF=//{}/y>", "<area href='https://{}?q'>"]
    pages, n = [], 0
    for h in [*hosts, "hub.com"]:
        for x, y in sorted(edges):
            if x == h:
                n += 1
                pages.append((n, f"http://{h}/fr/" if h == "good.org" else f"http://{h}/", rnd.choice(form).format(y)))
        pages.append((n + 1, f"http://{h}/fr/", "<a href='/relative'> <!-- <a href='http://bad.net/'> --> <script>'<a href=\"//bad.net\">'</script>"))
        n += 1
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["host"]: r for r in urls.judge(df.unionByName(df)).collect()}
    trust = ranks({"good.org": 1.0}, edges, urls.DAMPING)
    distrust = ranks({"bad.net": 1.0, "worse.net": 1.0}, {(y, x) for x, y in edges}, urls.DAMPING)
    for h, r in got.items():
        assert r["trust"] == pytest.approx(trust.get(h, 0.0), abs=2e-4) and r["distrust"] == pytest.approx(distrust.get(h, 0.0), abs=2e-4)
    assert sum(r["trust"] > 0 for r in got.values()) > 10 and {r["verdict"] for r in got.values()} == {"allow", "block"}
    # the same in SQL
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    want = {tuple(r) for r in con.execute(urls.judge_sql()).fetchall()}
    assert {tuple(r)[:5] for r in urls.judge(df).collect()} == want


def test_urls_of_no_pages_ties_and_long_pages(spark):
    schema = "page_id long, url string, html string"
    assert urls.judge(spark.createDataFrame([], schema)).count() == 0
    # as much trust as distrust: allowed
    pages = [(1, "http://a.net/", "<a href=//m.com>"), (2, "http://b.org/fr/", "<a href=//m.com>"), (3, "http://m.com/", "<a href=//a.net>"), (3, "http://m.com/", None), (4, "http://long.com/", "x " * 500_000 + "<a href='//a.net/'>" + "<" * 100_000 + "<!--" * 10_000)]
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(pages, schema)).collect()}
    assert got[3]["trust"] > 0 and got[3]["verdict"] == ("block" if got[3]["distrust"] > got[3]["trust"] and got[3]["distrust"] >= 0.075 else "allow")
    assert got[4]["distrust"] > 0 and got[1]["verdict"] == "block" and got[2]["verdict"] == "allow"
