import pytest
from pyspark.sql import functions as F

from lensaudit.functions import dates
from lensaudit.functions import html as H
from lensaudit.sources import crawl, facts, html_parser, robots, sitemap, structured

PAGE = """<!DOCTYPE html><html lang="en-GB"><head><title> A &amp; B </title><meta name="description" content=" D ">
<meta property='og:title' content='T'><meta name=robots content="noindex"><link rel="canonical" href="https://a/x"><script>var t="<h1>no</h1>";</script>
<script type="application/ld+json">[{"@type":"A"},{"@graph":[{"@type":["B","C"],"@type":["C"]}]}]</script></head>
<body><!-- <h2>no</h2> --><h3>Three</h3><h1>One <b>x</b></h1><h2></h2><time datetime="2024-01-02">t</time><main>text</main></body></html>"""


def test_expressions_and_parser_agree_on_a_page(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<p>unclosed <b>x")], "i int, html string")
    h = F.col("html")
    a = df.select("i", H.title(h).alias("title"), H.lang(h).alias("lang"), H.headings(h).alias("headings"), H.time_datetimes(h).alias("t"), H.has_main(h).alias("m"), F.size(H.canonicals(h)).alias("c"), H.skipped_levels(H.headings(h)).alias("s")).collect()
    b = html_parser.extract(df).collect()
    for x, y in zip(a, b):
        assert (x.title, x.lang, x.headings, x.t, x.m, x.c) == (y.title, y.lang, y.headings, y.time_datetimes, y.has_main, y.canonical_count)
    assert a[0].title == "A & B" and [(h.level, h.text) for h in a[0].headings] == [(1, "Onex"), (2, ""), (3, "Three")] and [tuple(x) for x in a[0].s] == [(1, 3)]
    assert b[0].description == "D" and b[0].robots_meta == "noindex" and b[0].meta_tags["og:title"] == "T" and len(b[0].ld_blocks) == 1


def test_json_ld():
    got = structured.parse_blocks(['[{"@type":"A"},{"@graph":[{"@type":["B","C"],"@type":["C"]}]}]', " ", "{bad,}", "3"])
    assert got["types"] == ["A", "C"] and got["parsed"] == 2 and [e[:7] for e in got["errors"]] == ["block 1", "block 2"] and got["blocks"] == 4


@pytest.mark.parametrize(("path", "token", "want"), [("/", "GPTBot", "blocked"), ("/a", "CCBot", "blocked"), ("/private/x", "Other", "blocked"), ("/private/ok", "Other", "allowed"), ("/x.pdf", "Other", "blocked"), ("/x.pdfs", "Other", "allowed"), ("/a(b", "Other", "blocked"), ("/z", "Search", "allowed")])
def test_robots_rules(spark, path, token, want):
    body = "User-agent: GPTBot # comment\nUser-agent: ccbot\nDisallow: /\n\nUser-agent: *\nDisallow: /private\nAllow: /private/ok\nDisallow: /*.pdf$\nDisallow: /a(b\nUser-agent: Search\nDisallow:\n"
    got = robots.verdicts(spark.createDataFrame([("s", body)], "site_id string, body string"), spark.createDataFrame([("s", token, token, path)], "site_id string, bot string, token string, path string"))
    assert [r.verdict for r in got.collect()] == [want]


def test_matcher_equals_regular_expressions():
    """Every rule as a regular expression against the compiled ones, on made-up patterns and paths."""
    import random
    import re

    rng = random.Random(6)
    some = lambda n, letters: "".join(rng.choice(letters) for _ in range(rng.randrange(n)))
    blocked = 0
    for _ in range(400):
        group = [("/" + some(6, "ab/*") + rng.choice(["", "", "$", "*", ".a"]), rng.random() < 0.4) for _ in range(rng.randrange(8))]
        compiled = robots.Matcher(group)
        for _ in range(20):
            path, best = "/" + some(9, "ab/.$"), (-1, True)
            for pattern, allow in group:
                core = ".*".join(map(re.escape, pattern.removesuffix("$").split("*")))
                if re.match(core + (r"\Z" if pattern.endswith("$") else ""), path):
                    best = max(best, (len(pattern), allow))
            assert compiled.allows(path) == best[1], (group, path)
            blocked += not best[1]
    assert blocked > 500


def test_a_large_site_is_judged_in_slices(spark, monkeypatch):
    monkeypatch.setattr(robots, "SLICE", 100)
    body = "User-agent: *\nDisallow: /x\nAllow: /x/ok\nUser-agent: GPTBot\nDisallow: /*7$\n"
    asks = spark.range(3000).selectExpr("'s' AS site_id", "element_at(array('GPTBot', 'CCBot', 'Other'), CAST(id % 3 AS int) + 1) AS bot", "concat(CASE WHEN id % 2 = 0 THEN '/x/' ELSE '/x/ok' END, id) AS path").withColumn("token", F.col("bot"))
    asks = asks.unionByName(spark.createDataFrame([("t", "b", "b", "/x"), ("u", "b", "b", "/x")], "site_id string, bot string, token string, path string"))
    got = robots.verdicts(spark.createDataFrame([("s", body), ("u", None)], "site_id string, body string"), asks).collect()
    assert len(got) == 3002 and {(r.verdict, r.robots_present) for r in got if r.site_id in "tu"} == {("allowed", False)}
    for r in got:
        if r.site_id == "s":
            want = r.path.endswith("7") if r.bot == "GPTBot" else not r.path.startswith("/x/ok")
            assert (r.verdict == "blocked") == want and r.robots_present


def test_no_robots_means_allowed(spark):
    got = robots.verdicts(spark.createDataFrame([("s", None)], "site_id string, body string"), spark.createDataFrame([("s", "b", "t", "/")], "site_id string, bot string, token string, path string")).collect()[0]
    assert (got.verdict, got.robots_present) == ("allowed", False)


def test_sitemaps(spark):
    ns = 'xmlns:sm="http://www.sitemaps.org/schemas/sitemap/0.9"'
    of = lambda xml: [r[:1] + r[2:] for r in sitemap.scan(xml.encode())]
    ok = ("file", None, None, None)
    assert of(f"<sm:urlset {ns}><sm:url><sm:loc> u </sm:loc><sm:lastmod>2024</sm:lastmod></sm:url></sm:urlset>") == [ok, ("entry", "u", "2024", None)]
    assert of("<sitemapindex><sitemap><loc>c</loc></sitemap></sitemapindex>") == [ok, ("child", "c", None, None)]
    assert of("<urlset><sitemap><loc>c</loc></sitemap><x><url><loc/><loc>d</loc></url></x></urlset>") == [ok, ("entry", "d", None, None)]
    for bad in ("<urlset><url>", "<urlset><url><loc>a</loc></url></urlset", "", "<a:b/>"):
        assert [(k, e.split(":")[0]) for k, *_, e in sitemap.scan(bad.encode())] == [("file", "XML parse error")]
    rows = spark.createDataFrame([(1, "<urlset><url><loc>a</loc></url></urlset>"), (2, None), (1, "<urlset/>")], "k long, body string")
    got = sorted((r.k, r.kind, r.loc, r.error is None) for r in sitemap.read(rows, ["k"]).collect())
    assert got == [(1, "entry", "a", True), (1, "file", None, True), (1, "file", None, True), (2, "file", None, False)]
    assert rows.select(sitemap.looks_like_sitemap(F.col("body"))).collect() == [(True,), (False,), (True,)] and not sitemap.is_sitemap(None)


def test_large_sitemaps_are_read_in_steps(spark):
    """A packed file of 50 MB, with and without a fault at its end."""
    import gzip
    import tracemalloc

    one = "<url><loc>http://a.net/%07d</loc><lastmod>2024-01-01</lastmod><priority>0.5</priority><changefreq>never</changefreq></url>\n"
    xml = ("<urlset>" + "".join(one % i for i in range(430_000)) + "</urlset>").encode()
    assert len(xml) > 50_000_000
    packed, bad = gzip.compress(xml, 1), gzip.compress(xml[:-9], 1)
    del xml
    tracemalloc.start()
    n = last = 0
    for row in sitemap.scan(packed):
        n, last = n + 1, row
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 430_001 and last == ("entry", 429_999, "http://a.net/0429999", "2024-01-01", None) and most < 100_000_000
    assert [r[0] for r in sitemap.scan(bad)] == ["file"]
    got = sitemap.read(spark.createDataFrame([(1, bytearray(packed))], "k long, body binary"), ["k"])
    assert got.groupBy("kind").count().orderBy("kind").collect() == [("entry", 430_000), ("file", 1)]


def test_sample_spreads_over_the_list(spark):
    rows = spark.createDataFrame([("s", "http://a/", i, f"http://a/{i}" if i else "http://a") for i in range(15)], "site_id string, start_url string, pos int, url string")
    got = {r.ord: r.url for r in sitemap.sample(rows, 5).collect()}
    assert got == {0: "http://a/", 1: "http://a/1", 2: "http://a/4", 3: "http://a/7", 4: "http://a/10"}


@pytest.mark.parametrize(("value", "want"), [("2024-03-01T10:00:00Z", "2024-03-01 10:00:00"), ("2024-03-01T10:00:00+0200", "2024-03-01 08:00:00"), ("2024-03-01T10:00:00.25Z", "2024-03-01 10:00:00.25"), ("2024/03/01", "2024-03-01 00:00:00"), ("1 Mar 2024", "2024-03-01 00:00:00"), ("Mar 1, 2024", "2024-03-01 00:00:00"), ("Fri, 01 Mar 2024 10:00:00 +0000", "2024-03-01 10:00:00"), ("2024-03-01 whatever", "2024-03-01 00:00:00"), ("2024-02-31", None), ("soon", None), (None, None)])
def test_dates(spark, value, want):
    got = spark.createDataFrame([(value,)], "v string").select(dates.parse_date(F.col("v")).cast("string")).collect()[0][0]
    assert got == want


def test_challenges_and_statuses(spark):
    rows = spark.createDataFrame([("Just a MOMENT...", 200, None), ("ok", 403, None), ("ok", 500, None), ("ok", 200, {"server": "Cloudflare", "CF-Mitigated": "x"}), ("", 200, {"server": "cloudflare", "cf-mitigated": "x"}), (None, None, None)], "body string, status int, headers map<string,string>")
    got = [(r[0], r[1]) for r in rows.select(crawl.challenge(F.col("body"), F.col("headers")), crawl.blocked_by(F.col("status"), crawl.challenge(F.col("body"), F.col("headers")))).collect()]
    assert got == [("cloudflare", "challenge"), (None, "waf"), (None, "status"), ("cloudflare", "challenge"), (None, None), (None, None)]


def test_bots_by_name_or_token(spark):
    assert [r.bot for r in crawl.bots(spark, ["gptbot", "BINGBOT"]).orderBy("ord").collect()] == ["GPTBot", "Bingbot"]
    with pytest.raises(KeyError):
        crawl.bots(spark, ["nobody"])


def test_facts(spark, tmp_path):
    f = tmp_path / "facts.yaml"
    f.write_text("site: https://a\nfacts:\n- question: How much?\n  answer: 5\n")
    with pytest.raises(ValueError):
        facts.load(spark, str(f))
    f.write_text("site: https://a\nfacts:\n- question: How much?\n  answer: five\n  page: /p\n")
    assert facts.load(spark, str(f)).collect()[0].answer == "five"
    for bad in ("- a", "{", None):
        if bad is None:
            f = tmp_path / "none.yaml"
        else:
            f.write_text(bad)
        with pytest.raises(ValueError):
            facts.load(spark, str(f))


MINIFIED = """<!doctype html><html lang=en><head><title>\tCaf&eacute; &mdash; x\n</title><meta name=description content="First&nbsp;one"><meta name=description content=Second><meta name=robots content=noindex><meta name=robots content=all><link rel=canonical href=/x></head><body><h1>H</h1>"""


def test_minified_pages(spark):
    fetched = spark.createDataFrame([("s", "https://a/x", 0, "browser", MINIFIED)], "site_id string, url string, pos int, lens string, body string")
    r = crawl.page_structure(fetched).collect()[0]
    assert (r.title, r.lang, r.description, r.robots_meta, r.canonical, r.canonical_count) == ("Café — x", "en", "First\xa0one", "noindex", "/x", 1)
    h = F.col("body")
    a = fetched.select(H.lang(h), F.size(H.canonicals(h)), H.attribute(F.try_element_at(H.canonicals(h), F.lit(1)), "href")).collect()[0]
    assert tuple(a) == ("en", 1, "/x")


def test_a_body_is_extracted_once(spark):
    page = "<html><body><main><p>" + "some words here " * 30 + "</p></main></body></html>"
    rows = [("s", "u", i, lens, body) for i, (lens, body) in enumerate((("browser", page), ("A", page), ("B", page), ("C", None), ("D", "")))]
    f = spark.createDataFrame(rows, "site_id string, url string, pos int, lens string, body string")
    slim, bodies = crawl.slim(f), crawl.extract_bodies(f)
    views = {r.lens: r for r in crawl.page_views(slim, bodies).collect()}
    assert bodies.count() == 1 and views["A"].text == views["browser-nojs"].text != "" and (views["C"].text, views["D"].extraction_mode, views["D"].shell_markers) == ("", "none", [])
