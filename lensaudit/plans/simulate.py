"""A deterministic crawl over plain pages: test data for queries, not an operator.

The tables at hand hold page bodies only. Tags are put into them by page_id, and answers
of the lenses follow from page_id and the lens's number, so that every check has sites
that pass, warn and fail. The rules are plain arithmetic, to be said again in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import urls

HEAD = """
CASE pmod(page_id, 4) WHEN 0 THEN '' WHEN 1 THEN '<meta name=description content=Short.><meta name="description" content="A second one.">' ELSE '<meta name="description" content="A description of this caf&eacute; page that is long enough to be read as a summary.&nbsp;">' END
|| CASE pmod(page_id, 5) WHEN 0 THEN '' WHEN 1 THEN '<link rel="canonical" href="https://other.example.org/x">' WHEN 2 THEN '<link rel=canonical href=/page>' WHEN 3 THEN '<link rel="canonical" href="' || url || '/">' ELSE '<link rel="canonical" href="' || url || '">' END
|| CASE WHEN pmod(page_id, 35) = 14 THEN '<link rel="canonical" href="' || url || '">' ELSE '' END
|| CASE pmod(page_id, 11) WHEN 3 THEN '<meta name="robots" content="noindex, nofollow"><meta name=robots content=all>' WHEN 5 THEN '<meta name="robots" content="nosnippet">' ELSE '' END
|| CASE WHEN pmod(page_id, 3) <> 0 THEN '<meta property="og:title" content="T">' ELSE '' END
|| CASE WHEN pmod(page_id, 3) = 1 THEN '<meta property="og:description" content="D">' ELSE '' END
|| CASE WHEN pmod(page_id, 2) = 0 THEN '<meta property="og:url" content="U"><meta property="og:image" content="I">' ELSE '' END
|| CASE pmod(page_id, 4) WHEN 1 THEN '<script type="application/ld+json">{"@type":"Article","datePublished":"2024-01-05","author":{"name":"Ann"}}</script>' WHEN 2 THEN '<script type="application/ld+json">{"@type":"Article",}</script>' WHEN 3 THEN '<script type="application/ld+json">{"@graph":[{"@type":"Organization"},{"@type":["WebSite","WebPage"],"publisher":"Acme"}]}</script>' ELSE '' END
|| CASE pmod(page_id, 6) WHEN 3 THEN '<meta property="article:published_time" content="2024-03-01T10:00:00Z">' WHEN 4 THEN '<meta property="article:published_time" content="yesterday">' ELSE '' END
|| '</head>'
"""
BODY = """
CASE pmod(page_id, 6) WHEN 1 THEN '<time datetime="2024-02-31x">then</time>' WHEN 2 THEN '<time datetime="2024-02-28">then</time>' ELSE '' END
|| CASE pmod(page_id, 8) WHEN 1 THEN '<h3>Deep</h3>' WHEN 2 THEN '<h2> </h2>' WHEN 3 THEN '<h1>Again</h1>' WHEN 4 THEN '<h2>A</h2><h5>B</h5>' WHEN 5 THEN '<h2>About the author</h2>' ELSE '' END
|| CASE pmod(page_id, 13) WHEN 1 THEN '<div id="root"></div>' WHEN 2 THEN '<script src="/_next/static/x.js"></script>' ELSE '' END
|| '</body>'
"""
LANG = "CASE pmod(page_id, 9) WHEN 4 THEN replace(html, '<html lang=\"', '<html lang=\"x_') WHEN 5 THEN replace(html, '<html lang=', '<html data-lang=') WHEN 7 THEN replace(html, '<html lang=\"en\"', '<html lang=en') ELSE html END"
CHALLENGE = "<html><head><title>Just a moment...</title></head><body>wait</body></html>"
#: What a lens gets, by h = (31 page_id + 17 lens number) mod 100; the browser only fails on some pages.
KIND = "CASE WHEN ord = 0 THEN CASE WHEN pmod(page_id, 41) = 40 THEN 'down' ELSE 'same' END WHEN pmod(page_id * 31 + ord * 17, 100) < 8 THEN 'waf' WHEN pmod(page_id * 31 + ord * 17, 100) < 12 THEN 'challenge' WHEN pmod(page_id * 31 + ord * 17, 100) < 16 THEN 'half' WHEN pmod(page_id * 31 + ord * 17, 100) < 18 THEN 'timeout' ELSE 'same' END"


def pages(raw: DataFrame) -> DataFrame:
    """``raw`` (page_id, url, html) with tags put in, site_id (the host) and pos. A table of fewer
    parts than there are cores is dealt out first."""
    cores = raw.sparkSession.sparkContext.defaultParallelism
    raw = raw if raw.rdd.getNumPartitions() >= cores else raw.repartition(cores)
    html = F.expr(f"CASE WHEN contains(html, '</body>') THEN replace(replace({LANG}, '</head>', {HEAD}), '</body>', {BODY}) ELSE replace({LANG}, '</head>', {HEAD}) || {BODY} END")
    return raw.select(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("site_id"), "url", F.col("page_id").cast("int").alias("pos"), html.alias("html"), "page_id")


def sites(simulated: DataFrame) -> DataFrame:
    """The start URL of a host is its page of the smallest id."""
    start = F.min_by("url", "page_id")
    return simulated.groupBy("site_id").agg(start.alias("start_url"), start.alias("final_url"))


def fetches(simulated: DataFrame) -> DataFrame:
    """One row for each page and lens: the browser and the default bots."""
    lenses = simulated.sparkSession.createDataFrame(list(enumerate(("browser", *fixed.DEFAULT_BOTS))), "ord int, lens string")
    rows = simulated.crossJoin(F.broadcast(lenses)).withColumn("kind", F.expr(KIND))
    body = F.expr(f"CASE kind WHEN 'same' THEN html WHEN 'half' THEN substring(html, 1, length(html) div 2) WHEN 'challenge' THEN '{CHALLENGE}' END")
    status = F.expr("CASE kind WHEN 'waf' THEN 403 WHEN 'down' THEN 503 WHEN 'timeout' THEN NULL ELSE 200 END")
    headers = F.expr("CASE WHEN pmod(page_id, 2) = 0 THEN map('strict-transport-security', 'max-age=63072000; includeSubDomains', 'server', 'x') ELSE map('server', 'x') END")
    hop = "named_struct('from', url, 'status', 301, 'to', concat(url, '{}'))"
    chain = F.expr(f"CASE WHEN pmod(page_id, 50) = 0 THEN array({hop.format('#a')}, {hop.format('#a')}) WHEN pmod(page_id, 25) = 0 THEN array({hop.format('#a')}, {hop.format('#b')}) WHEN pmod(page_id, 5) = 0 THEN array({hop.format('#a')}) ELSE array() END")
    error = F.expr("CASE WHEN kind = 'timeout' THEN 'timeout' END")
    return rows.select("site_id", "url", "pos", "lens", F.col("url").alias("final_url"), status.cast("int").alias("status"), headers.alias("headers"), body.alias("body"), F.lit(0).alias("elapsed_ms"), error.alias("error"), F.lit(None).cast("string").alias("blocked_by"), chain.alias("redirect_chain"), F.lit(None).cast("string").alias("challenge_marker"))


def rendered(simulated: DataFrame) -> DataFrame:
    """A rendered lens for every third page: text repeated page_id mod 4 more times."""
    body = F.expr("replace(html, '</article>', concat('<p>', repeat('Rendered words of this page. ', 100 * cast(pmod(page_id, 4) as int)), '</p></article>'))")
    rows = simulated.where("pmod(page_id, 3) = 0")
    nothing = {"status": "int", "headers": "map<string,string>", "error": "string", "blocked_by": "string", "redirect_chain": "array<struct<`from`:string,status:int,`to`:string>>", "challenge_marker": "string"}
    return rows.select("site_id", "url", "pos", F.lit("rendered").alias("lens"), F.col("url").alias("final_url"), body.alias("body"), F.lit(0).alias("elapsed_ms"), *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()))


ROBOTS = (
    "User-agent: *\nAllow: /\n",
    "User-agent: GPTBot\nUser-agent: CCBot\nDisallow: /\n\nUser-agent: *\nDisallow: /private\n",
    "User-agent: *\nDisallow: /\nAllow: /$\nAllow: /*/1\n",
    "# nothing\nUser-agent: ClaudeBot\nDisallow:\n\nUser-agent: *\nDisallow: /\n",
)


def robots(site: DataFrame) -> DataFrame:
    """robots.txt of a host by the length of its name modulo 5; the fifth kind has none."""
    kind = F.length("site_id") % 5
    body = F
    for i, text in enumerate(ROBOTS):
        body = body.when(kind == i, text)
    return site.select("site_id", body.alias("body"), F.lit(False).alias("parse_failed"))


def sitemap_entries(simulated: DataFrame) -> DataFrame:
    """Every page but those of page_id mod 7 = 6 is listed; lastmod by page_id mod 10."""
    last = F.expr("CASE pmod(page_id, 10) WHEN 1 THEN '2024-05-01' WHEN 2 THEN '2099-01-01' WHEN 3 THEN 'soon' WHEN 4 THEN '2024-05-01T10:00:00+02:00' WHEN 5 THEN '1970-01-01' END")
    return simulated.where("pmod(page_id, 7) <> 6").select("site_id", "pos", F.col("url").alias("loc"), last.alias("lastmod"))


def sitemap_files(simulated: DataFrame) -> DataFrame:
    """A file a page (page_id, body) by page_id mod 5: a sitemap, one with prefixed tags and a lastmod, an
    index of two, one that is cut off, a web page. Ampersands of URLs are escaped."""
    loc = F.replace("url", F.lit("&"), F.lit("&amp;"))
    kinds = (
        F.concat(F.lit("\n <urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'><url><loc> "), loc, F.lit("\n</loc></url><url><lastmod>2024-01-01</lastmod></url></urlset>")),
        F.concat(F.lit("<?xml version='1.0'?><m:urlset xmlns:m='x'><m:url><m:loc>"), loc, F.lit("</m:loc><m:lastmod>2024-05-01</m:lastmod></m:url><m:url><m:loc>"), loc, F.lit("#2</m:loc></m:url></m:urlset>")),
        F.concat(F.lit("<sitemapindex><sitemap><loc>"), loc, F.lit("/a.xml</loc></sitemap><sitemap><loc>"), loc, F.lit("/b.xml</loc></sitemap></sitemapindex>")),
        F.concat(F.lit("<urlset><url><loc>"), loc),
    )
    body = F
    for i, text in enumerate(kinds):
        body = body.when(F.pmod("page_id", F.lit(5)) == i, text)
    return simulated.select("page_id", body.otherwise(F.lit("<html><p>No such file.</p></html>")).alias("body"))


def llms(site: DataFrame) -> DataFrame:
    """/llms.txt by the length of the host's name modulo 4: fine, malformed, refused, gone."""
    kind = F.length("site_id") % 4
    body = F.when(kind == 0, "# Site\n\nAbout it.\n\n- [Home](/)\n").when(kind == 1, "- [Home](/)\n")
    return site.select("site_id", F.expr("CASE length(site_id) % 4 WHEN 2 THEN 500 WHEN 3 THEN 404 ELSE 200 END").alias("status"), F.when(kind == 2, "HTTP 500").when(kind == 3, "HTTP 404").alias("error"), body.alias("body"))
