"""Crawl snapshots: the tables that an audit reads, and how pages become them.

Long format throughout: one row for each site, URL and lens. Most lenses get the bytes that
the browser gets, so text is extracted once for each distinct body (``extract_bodies``), told
by its MD5 hash; later stages carry hashes, not bodies.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions import html as H
from ..functions import numbers, urls
from ..functions.text import any_of, bound
from . import html_parser, main_content, structured

FETCHES = "site_id string, url string, pos int, lens string, final_url string, status int, headers map<string, string>, body string, elapsed_ms int, error string, blocked_by string, redirect_chain array<struct<`from`: string, status: int, `to`: string>>, challenge_marker string"

#: What tells a page from others: of one URL a site may have several, at places of their own.
PAGE = ("site_id", "url", "pos")


@dataclass
class Crawl:
    """Tables keyed by site_id. ``sites``: site_id, start_url, final_url. ``verdicts``: bot,
    token, verdict, robots_present. ``sitemap``: as of ``sitemap.report``. ``entries``: loc,
    lastmod. ``llms``: status, error, body of /llms.txt. ``fetches`` has bytes and sha in place
    of the body, ``bodies`` what was extracted from each distinct one. Any table may be empty."""

    sites: DataFrame
    fetches: DataFrame
    bodies: DataFrame
    views: DataFrame
    structure: DataFrame
    robots: DataFrame
    verdicts: DataFrame
    sitemap: DataFrame
    entries: DataFrame
    llms: DataFrame


def bots(spark: SparkSession, names=fixed.DEFAULT_BOTS) -> DataFrame:
    """Rows of the registry for names or robots tokens in any case; unknown ones are an error."""
    by = {b[0].lower(): b for b in fixed.BOTS} | {b[2].lower(): b for b in fixed.BOTS if b[2].lower() not in {x[0].lower() for x in fixed.BOTS}}
    if bad := [n for n in names if n.strip().lower() not in by]:
        raise KeyError(f"unknown bots {', '.join(bad)}; known: {', '.join(sorted(b[0] for b in fixed.BOTS))}")
    rows = [by[n.strip().lower()] for n in names]
    return spark.createDataFrame([(i, *b) for i, b in enumerate(rows)], "ord int, bot string, user_agent string, token string, purpose string")


def lens_urls(pages: DataFrame, registry: DataFrame) -> DataFrame:
    """What to fetch: every URL by the browser and by every bot of the (at most 15-row) registry."""
    spark = pages.sparkSession
    browser = spark.createDataFrame([("browser", fixed.BROWSER_UA)], "lens string, user_agent string")
    lenses = browser.unionByName(registry.select(F.col("bot").alias("lens"), "user_agent"))
    return pages.crossJoin(F.broadcast(lenses))


def challenge(body: Column, headers: Column) -> Column:
    """Vendor of a challenge page, by the first needle in the first 200,000 characters, else
    by response headers; null if it is none."""
    names = F.transform(F.map_keys(headers), lambda k: F.lower(k))
    by_header = F.contains(F.lower(F.coalesce(F.try_element_at(headers, F.lit("server")), F.lit(""))), F.lit("cloudflare")) & F.coalesce(F.array_contains(names, "cf-mitigated"), F.lit(False))

    def vendor(low: Column) -> Column:
        out = F
        for needle, name in fixed.CHALLENGES:
            out = out.when(F.contains(low, F.lit(needle.lower())), F.lit(name))
        return F.when(low != "", out.when(by_header, F.lit("cloudflare")))

    return bound(F.lower(F.substring(F.coalesce(body, F.lit("")), 1, fixed.CHALLENGE_BYTES)), vendor)


def blocked_by(status: Column, marker: Column) -> Column:
    return F.when(marker.isNotNull(), "challenge").when(status.isin(*fixed.WAF_STATUS), "waf").when(status >= 400, "status")


def classify(fetches: DataFrame) -> DataFrame:
    """``fetches`` with challenge_marker, blocked_by, and an error for HTTP 400 and above."""
    out = fetches.withColumn("challenge_marker", challenge(F.col("body"), F.col("headers")))
    out = out.withColumn("blocked_by", blocked_by(F.col("status"), F.col("challenge_marker")))
    return out.withColumn("error", F.coalesce("error", F.when(F.col("status") >= 400, F.concat(F.lit("HTTP "), F.col("status")))))


def ok(prefix: str = "") -> Column:
    """An answer of 200 to 299 without error."""
    return F.col(f"{prefix}error").isNull() & F.coalesce(F.col(f"{prefix}status").between(200, 299), F.lit(False))


def slim(fetches: DataFrame) -> DataFrame:
    """``fetches`` with the body's size and hash in its place; an empty body has no hash."""
    rows = fetches.withColumns({"bytes": F.coalesce(F.octet_length("body"), F.lit(0)), "sha": F.md5(F.nullif("body", F.lit("")))})
    return rows.drop("body")


def statuses_by_bot(fetches: DataFrame) -> DataFrame:
    """The status that each fetching lens of a site got for the first page; null if it got none."""
    return fetches.where("lens <> 'rendered'").groupBy("site_id", "lens").agg(F.min_by("status", "pos").alias("status"))


def extract_bodies(fetches: DataFrame) -> DataFrame:
    """Main text and markers of every distinct body, by its hash ``sha``."""
    rows = fetches.where("body <> ''").select(F.md5("body").alias("sha"), "body")
    rows = rows.groupBy("sha").agg(F.first("body").alias("body"))  # all are the same
    body = F.col("body")
    rows = rows.select("sha", F.length(body).alias("html_chars"), H.framework_markers(body).alias("framework_markers"), H.shell_markers(body).alias("shell_markers"), "body")
    rows = main_content.extract(rows, "body")
    ratio = numbers.share(F.length("text"), F.col("html_chars"), 5)
    rows = rows.select("sha", "text", "extraction_mode", ratio.alias("extraction_ratio"), "html_chars", "framework_markers", "shell_markers")
    return rows.withColumn("text_chars", F.length("text"))


def page_views(fetched: DataFrame, bodies: DataFrame) -> DataFrame:
    """Main text and markers of every fetch; the browser's lens is called browser-nojs. Fetches
    without a body have no text."""
    lens = F.when(F.col("lens") == "browser", "browser-nojs").otherwise(F.col("lens"))
    rows = fetched.select("site_id", "url", "pos", lens.alias("lens"), "sha").join(bodies, "sha", "left")
    none = F.array().cast("array<string>")
    empty = {"text": F.lit(""), "extraction_mode": F.lit("none"), "extraction_ratio": F.lit(0.0), "html_chars": F.lit(0), "framework_markers": none, "shell_markers": none, "text_chars": F.lit(0)}
    return rows.select("site_id", "url", "pos", "lens", *(F.coalesce(c, v).alias(c) for c, v in empty.items()))


def page_structure(fetches: DataFrame) -> DataFrame:
    """Structure and structured data of the browser's pages, by the tolerant parser: attributes with
    and without quotes, all entities, of repeated description and robots tags the first."""
    rows = html_parser.extract(fetches.where("lens = 'browser'").select("site_id", "url", "pos", "body"), "body")
    rows = structured.parse(rows, "ld_blocks", "ld")
    return rows.select(
        "site_id", "url", "pos", urls.path(F.col("url")).alias("path"), "title", "description", "robots_meta", "lang", "canonical", "canonical_count", "meta_tags",
        F.map_filter("meta_tags", lambda k, _: k.startswith("og:")).alias("og"), "headings", H.skipped_levels(F.col("headings")).alias("skipped"), "time_datetimes", "has_main", "body_text", "ld",
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot rows from Parquet; only asked columns and row groups are read."""
    return spark.read.schema(FETCHES).parquet(path)


def has_any(text: Column, needles) -> Column:
    return any_of(F.lower(text), needles)
