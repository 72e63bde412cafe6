"""The audit: crawl snapshots to check results, scores and findings, for all sites at once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import urls
from ..operators import catalog, checks
from ..sources import crawl as C
from ..sources import robots as R
from ..sources import sitemap as S


def build(sites: DataFrame, fetches: DataFrame, robots_txt: DataFrame, entries: DataFrame, faults: DataFrame, llms: DataFrame, now: Column, bots: Sequence[str] = fixed.DEFAULT_BOTS, keep: bool = True) -> C.Crawl:
    """Tables of a crawl from raw snapshots. Texts and structure are read from bodies once, and
    kept on disk for the checks that share them (``release`` lets go of them); ``sites``:
    site_id, start_url, final_url; ``robots_txt``: site_id, body (null: none), parse_failed."""
    fetches = fetches.na.fill({"pos": 0})  # a part of a page's key
    slim, bodies, structure = C.slim(C.classify(fetches)), C.extract_bodies(fetches), C.page_structure(fetches)
    if keep:
        slim, bodies, structure = (x.persist(StorageLevel.DISK_ONLY) for x in (slim, bodies, structure))
    views = C.page_views(slim, bodies)
    target = F.regexp_extract("start_url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)  # rules may match the query string
    asks = sites.select("site_id", F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target)).alias("path")).crossJoin(F.broadcast(C.bots(sites.sparkSession, bots).select("bot", "token")))
    return C.Crawl(sites, slim, bodies, views, structure, robots_txt, R.verdicts(robots_txt, asks), S.report(sites, entries, faults, now), entries, llms)


def release(crawl: C.Crawl) -> None:
    """Drop what ``build`` keeps on disk."""
    for x in (crawl.fetches, crawl.bodies, crawl.structure):
        x.unpersist()


def run(crawl: C.Crawl, policy: str = "report", only: Sequence[str] = (), skip: Sequence[str] = ()) -> DataFrame:
    """Results of the selected checks, a row for each site and check."""
    chosen = catalog.select(only, skip)
    parts = [checks.CHECKS[i](crawl, policy) if i in ("ACC-001", "ACC-003") else checks.CHECKS[i](crawl) for i in chosen]
    return reduce(DataFrame.unionByName, parts)
