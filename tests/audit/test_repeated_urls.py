"""Pages that share a URL are pages of their own: each is joined to itself only."""

import pytest
from pyspark.sql import functions as F

from lensaudit.operators import checks, generate
from lensaudit.plans import audit
from lensaudit.sources import crawl as C

URL = "https://a.net/x"


def _page(n: int, head: str = "", more: str = "") -> str:
    return f"<html><head><title>Page {n}</title>{head}</head><body><main><h1>Head</h1><p>{f'Words of page {n} and nothing else at all. ' * (5 + 40 * n)}</p>{more}</main></body></html>"


LD = '<script type="application/ld+json">{"@type":"Article","author":{"name":"Ann"},"datePublished":"2024-01-05"}</script>'
PAGES = [(0, _page(0, LD)), (1, _page(1)), (2, "")]


@pytest.fixture(scope="module")
def crawl(spark):
    fetches = [("a", URL, pos, lens, URL, 200, {}, body, 1, None, None, [], None) for pos, body in PAGES for lens in ("browser", "GPTBot", "rendered")]
    sites = spark.createDataFrame([("a", URL, URL)], "site_id string, start_url string, final_url string")
    none = lambda ddl: spark.createDataFrame([], ddl)
    return audit.build(
        sites, spark.createDataFrame(fetches, C.FETCHES), none("site_id string, body string, parse_failed boolean"), none("site_id string, loc string, lastmod string"), none("site_id string, error string"),
        none("site_id string, status int, error string, body string"), F.lit("2025-01-01").cast("timestamp"), keep=False,
    )


def test_parity_of_each_page_with_itself(crawl):
    rows = checks.parity_rows(crawl).orderBy("pos").collect()
    assert [(r.pos, r.size_ratio, r.similarity) for r in rows] == [(0, 1.0, 1.0), (1, 1.0, 1.0), (2, rows[2].size_ratio, None)]


def test_rendered_text_of_each_page_beside_its_own(crawl):
    r = checks.nojs_text(crawl).select(F.get_json_object("evidence", "$.pages").alias("pages"), F.get_json_object("evidence", "$.mean_ratio").cast("double").alias("ratio")).first()
    assert (r.pages, r.ratio) == ("3", 1.0)


def test_authors_of_each_page(crawl):
    assert {(r.pos, r.value) for r in checks.author_rows(crawl).collect()} == {(0, "Ann"), (1, None), (2, None)}


def test_dates_of_each_page(crawl):
    assert {(r.pos, r.dates) for r in checks.page_dates(crawl).collect()} == {(0, 1), (1, 0), (2, 0)}


def test_only_pages_with_text_are_entries(crawl):
    assert {r.pos for r in generate.page_entries(crawl.views, crawl.structure, crawl.sites).collect()} == {0, 1}
