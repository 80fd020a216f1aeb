"""Small cases with known answers, and differential tests of what SQL cannot say."""

import gzip
import math
import random
import uuid

import pytest
from pyspark.sql import functions as F

from skein.functions import text, urls
from skein.operators import chunking, crawl, html, index, ranking, retrieval, robots, seeds, sitemap
from skein.plans import search as plans
from skein.sources import tables
from skein.streaming import admission


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def results(spark, rows):
    return spark.createDataFrame([(u, t, d, float(s), i) for i, (u, t, d, s) in enumerate(rows)], "source_url string, page_title string, description string, score double, rank int")


def order(spark, rows, query="", ranks=None):
    df = ranking.boost(results(spark, rows), query, ranks).orderBy(F.desc("boosted"), "rank")
    return [(r["source_url"], r["boosted"]) for r in df.collect()]


# ---- URLs ----


def test_normalize(spark):
    given = ["https://example.com:443/a?utm_source=x&keep=1#part", "http://Example.com:80", "https://u@h.example:8443/b", "ftp://example.com/", "nonsense", "https://e.example/a/../b/./c", "https://e.example/a b/ü", None]
    assert column(spark, given, urls.normalize) == ["https://example.com/a", "http://example.com/", "https://u@h.example:8443/b", None, None, "https://e.example/b/c", "https://e.example/a%20b/%C3%BC", None]


def test_normalize_odd_forms(spark):
    cases = {
        "https://exa mple.com/x": None, "https://a<b/": None, "https://a%41.example/": None, "https://e.example:99999/": None, "https://e.example:x/": None,
        "http:/example.com/x": "http://example.com/x", "https:example.com": "https://example.com/", "HTTPS:\\\\Example.com": "https://example.com/", "http://example.com\\a\\b?x=\\y": "http://example.com/a/b",
        "https://b\u00fccher.example/\u00fc": "https://b\u00fccher.example/%C3%BC", "https://e.example/a/%2e%2E/b": "https://e.example/b", "  https://e.example/a/. ": "https://e.example/a/", "ht\ntp://e.example/\ta": "http://e.example/a",
        "https://e.example:0443/a": "https://e.example/a", "https://e.example:/x": "https://e.example/x", "https://e.example:0/x": "https://e.example:0/x", "https://[::1]:8080/": "https://[::1]:8080/", "https://a:b@c@e.example/": "https://a:b%40c@e.example/",
    }
    assert column(spark, list(cases), urls.normalize) == list(cases.values())


def test_robots_patterns(spark):
    cases = [("/a/b", "/a", True), ("/a/b", "/b", False), ("/x/a.pdf", "/*.pdf$", True), ("/x/a.pdfs", "/*.pdf$", False), ("/ab", "/a$b", False), ("/a$b", "/a$b", True), ("/ab", "/ab*b$", False), ("/abb", "/ab*b$", True), ("/", "/$", True), ("/a", "/$", False), ("/a+b", "/*+", True), ("/" + "a" * 5000, "/" + "*a" * 200 + "b", False)]
    rows = spark.createDataFrame(cases, "path string, pattern string, want boolean")
    assert [r["want"] for r in rows.filter(robots.matches(F.col("path"), F.col("pattern")) != F.col("want")).collect()] == []


def test_depth_and_root(spark):
    given = ["https://example.com", "https://example.com/", "https://example.com/page", "https://example.com/a/b", "https://example.com/a/b/c"]
    assert column(spark, given, urls.path_depth) == [0, 0, 1, 2, 3]
    assert column(spark, given, urls.is_domain_root) == [True, True, False, False, False]


def test_searchable(spark):
    given = ["https://example.com/image.jpg", "https://example.com/file.PDF", "https://en.example.org/wiki/Site:About", "https://example.com/index.html", "no url"]
    assert column(spark, given, urls.is_searchable) == [False, False, True, True, True]


def test_traps(spark):
    given = ["https://example.com/search?q=x", "https://example.com/users/sign_in", "https://example.com/signup", "https://example.com/article?id=1"]
    assert column(spark, given, urls.is_crawl_trap) == [True, True, True, False]


def test_hosts(spark):
    assert column(spark, [" www.a.example.. ", "WWW.a.example", "b"], urls.normalize_host) == ["a.example", "www.a.example", "b"]
    assert column(spark, ["not a url", "https://x.example/1"], urls.diversity_host) == ["not a url", "x.example"]


# ---- ranking ----


def test_short_root_beats_long_root(spark):
    got = order(spark, [("https://home.fri3dl.dev", "t", "", 0.5), ("google.com", "t", "", 0.5)])
    assert [u for u, _ in got] == ["google.com", "https://home.fri3dl.dev"]
    assert got[0][1] == pytest.approx(1.8) and got[1][1] == pytest.approx(1.771739, abs=1e-6)


def test_coverage(spark):
    df = spark.createDataFrame([("Rust Web Crawler", "https://example.com/x"), ("Trusty crawlers", "https://example.com/x")], "t string, u string")
    got = [r[0] for r in df.select(ranking.coverage(text.tokens(F.lit("rust crawler missing")), F.col("t"), F.col("u"))).collect()]
    assert got == [pytest.approx(2 / 3), 0.0]
    assert df.select(ranking.coverage(text.tokens(F.lit("")), F.col("t"), F.col("u"))).first()[0] == 0.0


def test_navigational_root_wins(spark):
    got = order(spark, [("https://en.wikipedia.org/wiki/Wikipedia:About", "Wikipedia:About", "", 4.1), ("https://en.wikipedia.org/", "Wikipedia", "", 3.5)], "wikipedia")
    assert got[0] == ("https://en.wikipedia.org/", pytest.approx(9.77)) and got[1][1] == pytest.approx(6.871111, abs=1e-6)


def test_high_score_can_win(spark):
    got = order(spark, [("https://example.com/", "Home", "", 3.5), ("https://example.com/deep/page", "Other", "", 6.0)], "rust crawler")
    assert got == [("https://example.com/deep/page", pytest.approx(5.777241, abs=1e-6)), ("https://example.com/", pytest.approx(4.775))]


def test_popularity(spark):
    lines = spark.createDataFrame([("1,popular.example", 0), ("900000,unknown.example", 1), ("x,bad.example", 2), ("7,twice.example", 3), ("5,twice.example", 4)], "value string, pos long")
    ranks = ranking.parse_domain_ranks(lines)
    assert {r["host"]: r["rank"] for r in ranks.collect()} == {"popular.example": 1, "unknown.example": 900000, "twice.example": 5}
    got = order(spark, [("https://unknown.example/", "", "", 1), ("https://www.popular.example/", "", "", 1)], "", ranks)
    assert got[0][0] == "https://www.popular.example/"
    assert spark.range(1).select(ranking.popularity(F.lit(1000))).first()[0] == pytest.approx(1 - math.log(1000) / math.log(1e6))


DIVERSE = ["https://a.example/1", "https://a.example/2", "https://b.example/1", "https://c.example/1", "https://d.example/1", "https://e.example/1", "https://f.example/1"]


def placed(spark, given):
    df = spark.createDataFrame([(u, f"t{i}", "d", -float(i), i) for i, u in enumerate(given)], "source_url string, page_title string, description string, score double, rank int")
    return ranking.diversify(ranking.best_chunks(df, [F.desc("score")]))


def test_diversify(spark):
    got = [r["source_url"] for r in placed(spark, DIVERSE).orderBy("place").collect()]
    assert got == [DIVERSE[i] for i in (0, 2, 3, 4, 5, 1, 6)]
    mixed = ["not a url", "also not a url", "https://example.com/1", "https://example.com/2"]
    assert [r["source_url"] for r in placed(spark, mixed).orderBy("place").collect()] == mixed
    three = placed(spark, [DIVERSE[0], DIVERSE[1], DIVERSE[2]])
    assert [r["source_url"] for r in ranking.page_of(three, 2, 0).orderBy("place").collect()] == [DIVERSE[0], DIVERSE[2]]


def test_offset_after_dedup(spark):
    rows = placed(spark, [DIVERSE[0], DIVERSE[0], DIVERSE[1], DIVERSE[2]])
    assert rows.count() == 3
    assert [r["source_url"] for r in ranking.page_of(rows, 2, 1).orderBy("place").collect()] == [DIVERSE[2], DIVERSE[1]]
    assert ranking.knowledge_panel(rows, 1).count() == 0
    assert ranking.knowledge_panel(rows, 0).first().asDict() == {"title": "t0", "description": "d", "url": DIVERSE[0]}


def test_prepare():
    p = plans.prepare("  rust   web\tcrawler  ", 500, 500)
    assert (p.query, p.limit, p.offset, p.candidates) == ("rust web crawler", 50, 200, 1000)
    with pytest.raises(ValueError):
        plans.prepare(" \n\t ")


# ---- pages ----


def test_blocks():
    page = "<body><nav><p>No</p></nav><h1>Title</h1><p>One</p><ul><li>Two</li></ul><table><tr><td>Three<style>x</style></td></tr></table><div class='my-Sidebar'><p>no</p></div><div>lost</div></body>"
    assert html.parse(page)[2] == [("Title", "One"), ("Title", "Two"), ("Title", "Three")]
    assert html.parse("<p>a<p>b<div>c</div><p>foo<b>bar</b>\n baz")[2] == [(None, "a"), (None, "b"), (None, "foo bar baz")]
    assert html.parse("<body class='has-sidebar'><p>x</p></body>")[2] in ([], [(None, "x")])
    assert html.parse("<div><h2>In</h2></div><p>after</p>")[2] == [("In", "after")]


def test_descriptions():
    assert html.parse('<meta name="description" content=" Meta  text "><meta property="og:description" content="OG">')[1] == "Meta text"
    assert html.parse('<meta name="description" content=" "><meta property="og:description" content="OG">')[1] == "OG"
    assert html.parse("<h1>Heading only here long enough</h1><p>short</p><p>this block is long enough</p>")[1] == "this block is long enough"
    long = html.parse("<p>" + "word " * 100 + "</p>")[1]
    assert long.endswith("...") and len(long) > 247


def test_links(spark):
    page = '<a href="/page">p</a><a href="/photo.jpg">x</a><a href="doc.pdf">x</a><a href="mailto:x@y">m</a><a href=" ">e</a>'
    pages = spark.createDataFrame([(1, "https://example.com/dir/", page), (2, "https://example.com/", None)], "page_id long, url string, html string")
    assert [r["target"] for r in html.links(html.extract(pages)).collect()] == ["https://example.com/page"]


def test_canonical_is_ignored(spark):
    pages = spark.createDataFrame([(1, "https://example.com/real", '<link rel="canonical" href="/"><p>some text</p>')], "page_id long, url string, html string")
    assert [r["source_url"] for r in chunking.chunks(html.extract(pages)).collect()] == ["https://example.com/real"]


def model_split(t):
    """The same cut, a character at a time."""
    if len(t) <= 1200:
        return [t]
    blank, out, at = set(html.SPACES), [], 0
    while at < len(t):
        end = min(at + 1200, len(t))
        if end < len(t):
            cut = next((i for i in range(end - 1, at, -1) if t[i] in blank), None)
            end = cut if cut else min(at + 450, len(t))
        out.append("".join(t[at:end]).strip(html.SPACES))
        at = end
        while at < len(t) and t[at] in blank:
            at += 1
    return out


def test_split_and_pack():
    assert len(chunking.split("界" * 1300)[0]) == 450
    rng = random.Random(1)
    for _ in range(200):
        t = "".join(rng.choice(["a", "é", " ", "\n", " ", "xyz" * rng.randint(1, 300)]) for _ in range(rng.randint(0, 60)))
        assert chunking.split(t) == model_split(t)
    for body in ("word " * 500, "مرحبا" * 300, "你好世界" * 400):
        chunks = chunking.pack([("H", body), (None, "tail")])
        assert chunks and all(len(c) <= 1200 and h == "H" for h, c in chunks)
    assert chunking.pack([("A", "x" * 700), ("B", "y" * 700), (None, "z")]) == [("A", "x" * 700), ("B", "y" * 700 + " z")]
    assert chunking.pack([("A", " "), (None, "")]) == []


def test_app_shell(spark):
    assert column(spark, ["  ", '<div id="root"></div>', '<div id="app"><p>x</p></div>', "<p>x</p>"], text.is_app_shell) == [True, True, False, False]


# ---- index ----


def chunk_rows(spark, rows):
    return spark.createDataFrame([(u, "t", h, "d", c, i) for u, h, c, i in rows], "source_url string, page_title string, chunk_heading string, description string, chunk_content string, chunk_index long")


def test_versions_and_points(spark):
    import hashlib

    c = chunk_rows(spark, [("https://a.example/", "h", "one", 0), ("https://a.example/", None, "two", 1)])
    v = index.page_versions(c).first()["page_version"]
    assert v == hashlib.sha256(b"thdone\0tdtwo\0").hexdigest()
    got = {r["chunk_index"]: r["point_id"] for r in index.points(c, index.page_versions(c)).collect()}
    assert got == {i: str(uuid.uuid5(uuid.NAMESPACE_URL, f"https://a.example/\0{v}\0{i}")) for i in (0, 1)}


def test_reindexing(spark):
    first = chunk_rows(spark, [("u1", None, "a", 0), ("u1", None, "b", 1), ("u2", None, "c", 0)])
    points = index.points(first, index.page_versions(first))
    again = index.index_pages(points, first)
    assert again.count() == 3 and again.select("point_id").distinct().count() == 3
    second = index.index_pages(points, chunk_rows(spark, [("u1", None, "new", 0)]))
    assert sorted((r["source_url"], r["chunk_content"]) for r in second.collect()) == [("u1", "new"), ("u2", "c")]
    assert index.index_pages(points, first.limit(0)).count() == 3


def test_payloads(spark):
    rows = spark.createDataFrame([(1, '{"chunk_content": "x"}'), (2, '{"page_title": null}'), (3, '{"paid": "no"}'), (4, "broken"), (5, '{"chunk_heading": null, "tags": ["a"], "score": 2.5}')], "id int, payload string")
    got = {r["id"]: r for r in index.decode_payload(rows).collect()}
    assert set(got) == {1, 5} and got[1]["page_title"] == "No Title" and got[5]["tags"] == ["a"] and got[5]["payload_score"] == 2.5


def test_search_end_to_end(spark, tmp_path):
    pages = spark.createDataFrame([(1, "https://rust.example/", "<title>Rust</title><p>Rust is a language for systems</p>"), (2, "https://rust.example/book", "<title>Book</title><p>The book on rust and crawlers</p>"), (3, "https://cook.example/", "<title>Food</title><p>Bread with butter</p>"), (4, "https://rust.example/a.pdf", "<title>Rust</title><p>rust rust rust</p>")], "page_id long, url string, html string")
    c = chunking.chunks(html.extract(pages), 7)
    stored = retrieval.embed(index.points(c, index.page_versions(c)), "passage")
    r = plans.search(stored, "rust", limit=2)
    assert [x["source_url"] for x in r.results.collect()][0] == "https://rust.example/" and r.panel.first()["title"] == "Rust" and r.total.first()["total"] == 3
    assert plans.search(stored, "rust", limit=0, offset=0).results.count() == 0
    plans.store_postings(stored, str(tmp_path), 2)
    assert plans.search(stored, "rust", limit=2, postings=str(tmp_path)).results.collect() == r.results.collect()
    s = plans.similar(stored, "Rust is a language for systems").first()
    assert s["is_similar"] and s["matches"][0]["source_url"] == "https://rust.example/"
    none = plans.similar(stored.limit(0), "x", 0.0).first()
    assert none["is_similar"] and none["score"] == 0.0 and none["matches"] == []
    assert plans.page(stored, "https://cook.example/").count() == 1 and plans.page(stored, "https://cook.example").count() == 0 and plans.count(stored).first()["count"] == 4


def test_embedding_order(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "i int, t string")
    got = {r["i"]: r["dense"] for r in retrieval.embed(df, "t").collect()}
    assert all(len(v) == 384 and v == pytest.approx(retrieval.hash_embedding(f"text {i}"), abs=1e-6) for i, v in got.items())


# ---- crawl ----


def test_robots(spark):
    body = "User-agent: *\nDisallow: /private\nAllow: /private/ok # yes\nDisallow: /*?q=\nSitemap: https://e.example/s.xml\nSitemap: /relative.xml\nUser-agent: mybot\nUser-agent: other\nDisallow: /only$\n"
    rows = spark.createDataFrame([("https://e.example", body)], "origin string, body string")
    assert [r["url"] for r in robots.sitemaps(rows).collect()] == ["https://e.example/s.xml"]
    given = spark.createDataFrame([(u,) for u in ("https://e.example/private/x", "https://e.example/private/ok", "https://e.example/a?q=1", "https://e.example/only", "https://e.example/only/more", "https://f.example/private")], "url string")
    star = {r["url"]: r["allowed"] for r in robots.allowed(given, robots.rules(rows, "unknown")).collect()}
    assert star == {"https://e.example/private/x": False, "https://e.example/private/ok": True, "https://e.example/a?q=1": False, "https://e.example/only": True, "https://e.example/only/more": True, "https://f.example/private": True}
    own = {r["url"]: r["allowed"] for r in robots.allowed(given, robots.rules(rows, "MyBot")).collect()}
    assert not own["https://e.example/only"] and own["https://e.example/only/more"] and own["https://e.example/private/x"]


def test_sitemaps(spark):
    urlset = '<urlset xmlns="x"><url><loc>https://e.example/old</loc><lastmod>2020-01-01</lastmod></url><url><loc>https://e.example/none</loc></url><url><loc>https://e.example/new#f</loc><lastmod>2024-05-01T10:00:00Z</lastmod></url><url><loc>https://other.example/x</loc></url></urlset>'
    nested = '<sitemapindex><sitemap><loc>https://e.example/b.xml.gz</loc></sitemap><sitemap><loc>https://e.example/bad.xml</loc></sitemap></sitemapindex>'
    files = spark.createDataFrame([("https://e.example/sitemap.xml", nested.encode(), None), ("https://e.example/b.xml.gz", gzip.compress(urlset.encode()), None), ("https://e.example/bad.xml", b"<urlset><url>", "text/xml"), ("https://e.example/t.xml", gzip.compress(urlset.encode()), "application/gzip; x=1")], "url string, content binary, content_type string")
    entries = sitemap.entries(files)
    assert entries.filter("kind = 'sitemap'").count() == 2 and entries.filter("kind = 'url'").count() == 8
    found = sitemap.discover(entries, "https://e.example/", [], 100).orderBy("pos").collect()
    assert [r["url"] for r in found] == ["https://e.example/new", "https://e.example/old", "https://e.example/none"]
    assert sitemap.discover(entries, "https://e.example/", ["https://e.example/t.xml"], 100).count() == 3


def model_crawl(fetches, links, seed, max_pages, max_depth):
    """One URL at a time, first in, first out."""
    from collections import deque

    queue, visited, blocked, out, pages = deque([(seed, 0)]), set(), set(), [], 0
    waiting = {seed}
    while queue:
        url, depth = queue.popleft()
        waiting.discard(url)
        if pages >= max_pages or depth > max_depth or url in visited or url.split("/")[2] in blocked:
            continue
        visited.add(url)
        final, outcome = fetches.get(url, (url, "failed"))
        out.append((url, depth, outcome))
        if outcome == "blocked":
            blocked.add(url.split("/")[2])
        if outcome != "ok":
            continue
        visited.add(final)
        pages += 1
        for target in links.get(final, []):
            if target not in visited and target not in waiting:
                waiting.add(target)
                queue.append((target, depth + 1))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_crawl_like_a_queue(spark, seed):
    rng = random.Random(seed)
    names = [f"https://{'abc'[i % 3]}.example/{i}" for i in range(24)]
    fetches = {u: (u, rng.choices(["ok", "failed", "blocked"], [8, 1, 1])[0]) for u in names[1:] if rng.random() < 0.95} | {names[0]: (names[0], "ok")}
    links = {u: rng.choices(names, k=rng.randint(0, 5)) for u in names}
    want = model_crawl(fetches, links, names[0], 9, 3)
    f = spark.createDataFrame([(u, a, b) for u, (a, b) in fetches.items()], "url string, final_url string, outcome string")
    e = spark.createDataFrame([(u, i, t) for u, ts in links.items() for i, t in enumerate(ts)], "url string, pos int, target string")
    got = crawl.crawl(spark, f, e, names[0], 9, 3, same_domain=False)
    assert [(r["url"], r["depth"], r["outcome"]) for r in got.pages.orderBy("depth", "ord").collect()] == want
    assert got.stats.first()["crawled"] == sum(o == "ok" for *_, o in want)


def test_fetch_outcome(spark):
    df = spark.createDataFrame([(200, "text/html; charset=x", 10), (200, "application/pdf", 10), (403, "text/html", 10), (200, "text/html", 6_000_000), (500, "text/html", 1), (None, None, None)], "s int, c string, n int")
    assert [r[0] for r in df.select(crawl.outcome(F.col("s"), F.col("c"), F.col("n"))).collect()] == ["ok", "failed", "blocked", "too_large", "failed", "failed"]


def test_redirects(spark):
    hops = spark.createDataFrame([("https://a.example/1", "/2"), ("https://a.example/2", "https://b.example/3?x=1"), ("https://l.example/", "https://l.example/"), ("https://n.example/", None)], "src string, location string")
    starts = spark.createDataFrame([("https://a.example/1",), ("https://l.example/",), ("https://z.example/",), ("https://n.example/",)], "url string")
    assert {r["url"]: r["final_url"] for r in crawl.follow_redirects(hops, starts, 3).collect()} == {"https://a.example/1": "https://b.example/3", "https://l.example/": None, "https://z.example/": "https://z.example/", "https://n.example/": None}


def test_seeds(spark, tmp_path):
    (tmp_path / "seeds.txt").write_text("# list\n\n https://a.example/1 \nhttps://a.example/2\nhttps://b.example/1\nhttps://www.google.com/x\nmailto:x\nhttps://a.example/login\n")
    (tmp_path / "done.txt").write_text("https://a.example/2\n")
    plan = seeds.plan(tables.seeds(spark, str(tmp_path / "seeds.txt")), tables.progress(spark, str(tmp_path / "done.txt"))).orderBy("place")
    assert [(r["url"], r["due_ms"]) for r in plan.collect()] == [("https://a.example/1", 0), ("https://b.example/1", 200)]
    assert tables.progress(spark, str(tmp_path / "none.txt")).count() == 0
    assert tables.config({"a": 1, "b": 2}) == {"a": 1, "b": 2} and tables.number("x", 4) == 4 and tables.number("12", 4) == 12
    assert tables.env_file("A=1\n#B=2\nC='x y'\nD=\"q\"\n", {"A": "0"}) == {"A": "0", "C": "x y", "D": "q"}
    assert tables.domain_ranks(spark, str(tmp_path / "none.csv")).count() == 0


# ---- streams ----


def test_admission_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('{"url": "https://e.example/?x", "max_pages": 3}\n{"url": "https://e.example/login", "max_pages": 3}\n{"url": "x", "max_pages": 1}\n{"url": "https://e.example/"}\nbroken\n')
    stream = admission.admit(spark.readStream.text(str(folder))).writeStream.format("memory").queryName("admitted").trigger(availableNow=True).start()
    stream.awaitTermination(120)
    got = sorted((str(r["seed"]), str(r["error"])) for r in spark.table("admitted").collect())
    assert ("https://e.example/", "None") in got and ("https://e.example/login", "crawl trap") in got and len(got) == 5
    assert [r["max_depth"] for r in spark.table("admitted").filter("error IS NULL").collect()] == [10]


def test_throttle_stream_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), i, float(rng.randint(0, 40))) for i in range(40)]
    df = spark.createDataFrame(rows, "origin string, id long, arrival double")
    df.write.parquet(str(tmp_path / "in"))
    stream = admission.throttle(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("throttled").outputMode("append").trigger(availableNow=True).start()
    stream.awaitTermination(180)
    want = sorted((r["id"], r["start"]) for r in crawl.politeness(df).collect())
    assert sorted((r["id"], r["start"]) for r in spark.table("throttled").collect()) == want
    assert all(b - a >= 2 for o in "ab" for a, b in zip(*(lambda s: (s, s[1:]))(sorted(s for (i, s) in want if rows[i][0] == o))))


def test_html_of_any_shape(spark):
    """Unknown section marks, titles and bodies nested without end: a page gives its row, and others theirs."""
    pages = [(1, "<p>a</p><![foo[x]]><p>b</p>"), (2, "<title>" + "<b>" * 5000 + "t</title><p>c</p>"), (3, "<div>" * 20000 + "<p>d</p>"), (4, "<p>e</p><![CDATA["), (5, None)]
    got = {r["page_id"]: [b["text"] for b in r["blocks"]] for r in html.extract(spark.createDataFrame([(i, "http://a/", h) for i, h in pages], "page_id long, url string, html string")).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5] and got[1] == ["a", "b"] and "d" in got[3] and got[4] == ["e"] and got[5] == []


def test_no_answer_is_tried_again(spark):
    rows = spark.createDataFrame([(None, 0), (None, 1), (None, 2), (404, 0), (500, 0)], "status int, attempt int")
    wait = crawl.retry_wait(F.col("status"), F.col("attempt"), F.lit(None).cast("string"), F.lit(0), F.lit(0))
    assert [r[0] for r in rows.select(wait).collect()] == [1000, 2000, None, None, 1000]


def test_empty_index_has_vectors(spark):
    empty = plans.empty_index(spark)
    assert dict(empty.dtypes)["dense"] == "array<float>" and plans.search(empty, "word").results.count() == 0


def test_stored_postings(spark, tmp_path):
    texts = [("a", "The cat. The CAT sat"), ("b", None), ("c", ""), ("d", "cat dog dog dog é É"), ("e", "no match here"), (None, "dog")]
    df = spark.createDataFrame(texts, "point_id string, body_text string").withColumn("title_text", F.col("body_text"))
    plans.store_postings(df, str(tmp_path), 3)
    plans.store_postings(df, str(tmp_path), 3)
    for asked in ("cat the", "dog", "é cat cat", "absent", "..."):
        for average in (256.0, None):
            want = sorted(map(str, retrieval.bm25(df, "point_id", "body_text", asked, average).collect()))
            assert sorted(map(str, retrieval.bm25_stored(spark, f"{tmp_path}/body", asked, "point_id", average).collect())) == want
    found = retrieval.bm25_stored(spark, f"{tmp_path}/body", "cat dog", "point_id")
    assert "In(term, [cat,dog])" in found._jdf.queryExecution().executedPlan().toString()
    retrieval.store_postings(df.limit(0), "point_id", "body_text", f"{tmp_path}/none")
    assert retrieval.bm25_stored(spark, f"{tmp_path}/none", "cat", "point_id", None).count() == 0
