"""Live crawls of many sites into a snapshot folder.

Answers are kept by key (URL, lens, user agent, limits) in the folder's ``_fetched``: a crawl of other
sites, bots or pages into the same folder fetches what is missing and no more, a crawl that was
stopped goes on, and the tables beside it are those of the last crawl.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import urls
from . import crawl, fetch, robots, sitemap, store

#: The tables of a snapshot; those with _ are for the crawl only.
TABLES = ("_fetched", "_listed", "_parsed", "entries", "faults", "fetches", "llms", "robots", "sites", "warnings")
WARNINGS = "site_id string, code string, severity string, message string, url string"


_READ = ("kind", "i", "loc", "lastmod", "error")


def answers(path: str) -> store.Store:
    """What a snapshot folder keeps of all fetches into it."""
    return store.Store(f"{path}/_fetched", fetch.KEPT)


def _root(start_url: Column) -> Column:
    return F.concat(urls.scheme(start_url), F.lit("://"), urls.netloc(start_url))


def _asks(pages: DataFrame) -> DataFrame:
    """``pages`` (site_id, url, pos) as a plan for the browser's lens."""
    return pages.select("site_id", "url", F.col("pos").cast("int").alias("pos"), F.lit("browser").alias("lens"), F.lit(fixed.BROWSER_UA).alias("user_agent"))


def snapshot(spark: SparkSession, sites: DataFrame, path: str, max_pages: int = 10, bots: Sequence[str] = fixed.DEFAULT_BOTS, get=fetch.http_get, lookup=fetch.resolve, limits: fetch.Limits = fetch.Limits(), most_seconds: float | None = None) -> None:  # noqa: B008
    """Crawl ``sites`` (site_id, start_url; one row a site) into the tables that an audit reads.

    robots.txt: an answer of 404 or 410, or none, is no file; other failures are warnings. The
    first candidate that is a sitemap is used, with the children it names, one level deep.
    Pages are the start URL and a spread of listed URLs, each by the browser and every bot. A
    browser's fetch that fails is an error row in ``warnings``. An empty table gives empty ones.
    Kept answers older than ``most_seconds`` are fetched again; 0 takes none.
    """
    registry, kept = crawl.bots(spark, bots), answers(path)

    def put(name: str, made: DataFrame) -> DataFrame:
        made.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.schema(made.schema).parquet(f"{path}/{name}")

    def fetched(plan: DataFrame, until=None, usable: Column | None = None) -> DataFrame:
        return fetch.through(kept, plan, get, lookup, limits, until, usable, most_seconds)

    start = sites.select("site_id", "start_url")
    root = start.select("site_id", "start_url", _root(F.col("start_url")).alias("root"))
    at = lambda name: _asks(root.select("site_id", F.concat("root", F.lit(name)).alias("url"), F.lit(0).alias("pos")))

    raw = fetched(at("/robots.txt"))
    rules = put("robots", raw.select("site_id", F.when(crawl.ok() & (F.col("body") != ""), F.col("body")).alias("body"), F.lit(False).alias("parse_failed")))
    maps = fetched(_asks(sitemap.candidates(start, robots.sitemaps(rules)).withColumnRenamed("ord", "pos")), lambda r: sitemap.is_sitemap(r["body"]), sitemap.looks_like_sitemap(F.col("body")))
    maps = maps.where(sitemap.looks_like_sitemap(F.col("body")))
    # the first usable one; others may be there from crawls when the first was not
    maps = maps.groupBy("site_id").agg(F.min_by(F.struct(*(c for c in maps.columns if c != "site_id")), "pos").alias("r")).select("site_id", "r.*")
    first = put("_parsed", sitemap.read(maps, ["site_id"]))
    nested = fetched(_asks(first.where("kind = 'child'").select("site_id", F.col("i").alias("pos"), F.col("loc").alias("url"))))
    nested = sitemap.read(nested.where(sitemap.looks_like_sitemap(F.col("body"))), ["site_id", "pos"])
    # places: those of the first file, then of its children in their order
    listed = put("_listed", first.select("site_id", F.lit(-1).alias("file"), *_READ).unionByName(nested.select("site_id", F.col("pos").alias("file"), *_READ)))
    entries = listed.where("kind = 'entry'").withColumn("pos", F.expr("(file + 1L) * 4294967296 + i"))
    put("entries", entries.select("site_id", "loc", "lastmod"))
    # a row without an error says that the site has a sitemap
    put("faults", listed.where("kind = 'file'").select("site_id", "error"))

    known = entries.join(start, "site_id").select("site_id", "start_url", "pos", F.col("loc").alias("url"))
    spread = sitemap.sample(known, max_pages).where("ord > 0").select("site_id", F.col("ord").alias("pos"), "url")
    chosen = start.select("site_id", F.lit(0).alias("pos"), F.col("start_url").alias("url")).unionByName(spread)
    # a URL that is listed twice is fetched once, at its first place
    chosen = chosen.groupBy("site_id", "url").agg(F.min("pos").alias("pos"))
    place = F.row_number().over(Window.partitionBy("site_id").orderBy("pos")) - 1  # at most max_pages rows a site
    got = put("fetches", fetched(crawl.lens_urls(chosen.withColumn("pos", place), registry)))
    landed = got.where("lens = 'browser' AND status IS NOT NULL").groupBy("site_id").agg(F.max_by("final_url", "pos").alias("final_url"))
    put("sites", start.join(landed, "site_id", "left").select("site_id", "start_url", F.coalesce("final_url", "start_url").alias("final_url")))
    put("llms", fetched(at("/llms.txt")).select("site_id", "status", "error", "body"))
    put("warnings", warnings(raw, got))


def warnings(robots_rows: DataFrame, fetches: DataFrame) -> DataFrame:
    """What went wrong while fetching: robots.txt files that answered, but not with a file, and pages
    that the browser did not get; a refused address has a code of its own."""
    refused = F.col("error").startswith("blocked:")
    lost = robots_rows.where(~crawl.ok() & ~F.coalesce(F.col("status").isin(404, 410), F.lit(True)))
    lost = lost.select("site_id", F.lit("ROBOTS_FETCH").alias("code"), F.lit("warning").alias("severity"), F.concat(F.lit("Could not read robots.txt: "), "error").alias("message"), "url")
    pages = fetches.where("lens = 'browser' AND error IS NOT NULL")
    pages = pages.select("site_id", F.when(refused, "BLOCKED_TARGET").otherwise("FETCH_FAILED").alias("code"), F.lit("error").alias("severity"), F.concat(F.lit("Could not fetch the page: "), "error").alias("message"), "url")
    return lost.unionByName(pages)


def reached(spark: SparkSession, path: str) -> DataFrame:
    """site_id, refused and reached of each crawled site: whether an address was refused, and whether
    the browser got any page."""
    bad = spark.read.schema(WARNINGS).parquet(f"{path}/warnings").where("code = 'BLOCKED_TARGET'").select("site_id", F.lit(True).alias("refused")).distinct()
    got = crawl.read(spark, f"{path}/fetches").where((F.col("lens") == "browser") & F.col("error").isNull()).select("site_id", F.lit(True).alias("reached")).distinct()
    no = F.lit(False)
    return spark.read.parquet(f"{path}/sites").select("site_id").join(bad, "site_id", "left").join(got, "site_id", "left").select("site_id", F.coalesce("refused", no).alias("refused"), F.coalesce("reached", no).alias("reached"))
