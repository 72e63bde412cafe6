"""Statuses of small sites, one fault each."""

import pytest
from pyspark.sql import functions as F

from lensaudit import fixed
from lensaudit.operators import catalog, report, scoring
from lensaudit.plans import audit
from lensaudit.sources import crawl as C

GOOD = (
    '<html lang="en"><head><title>A specific enough title</title><meta name="description" content="' + "d" * 80 + '"><link rel="canonical" href="{url}">'
    '<meta property="og:title" content="t"><meta property="og:description" content="d"><meta property="og:url" content="u"><meta property="og:image" content="i">'
    '<meta property="article:published_time" content="2024-01-02"><script type="application/ld+json">{{"@type":["Organization","WebSite","Corporation","LocalBusiness","Person"],"author":"Ann"}}</script></head>'
    "<body><main><h1>Head</h1><h2>Sub</h2><p>" + "Some words of main text. " * 80 + "</p></main></body></html>"
)
HSTS = {"strict-transport-security": "max-age=9"}
SITES = {
    "good": {},
    "challenge": {"bot": ("<title>Just a moment...</title>", 200)},
    "waf": {"bot": ("", 403)},
    "shell": {"page": '<html><head></head><body><div id="root"></div></body></html>'},
    "http": {"scheme": "http"},
    "down": {"status": 503},
    "blocked": {"robots": "User-agent: *\nDisallow: /\n"},
    "norobots": {"robots": None},
    "stale": {"lastmod": "2099-01-01"},
    "nohsts": {"headers": {}},
}


@pytest.fixture(scope="module")
def statuses(spark):
    sites, fetches, robots, entries, llms = [], [], [], [], []
    for name, s in SITES.items():
        url = f"{s.get('scheme', 'https')}://{name}.net/"
        sites.append((name, url, url))
        page = s.get("page", GOOD).replace("{url}", url).replace("{{", "{").replace("}}", "}")
        for lens in ("browser", *fixed.DEFAULT_BOTS):
            body, status = (page, s.get("status", 200)) if lens == "browser" or "bot" not in s else s["bot"]
            fetches.append((name, url, 0, lens, url, status, s.get("headers", HSTS), body, 1, None, None, [], None))
        robots.append((name, s.get("robots", "User-agent: *\nAllow: /\n"), False))
        entries.append((name, url, s.get("lastmod", "2024-01-01")))
        llms.append((name, 200, None, "# T\n\ns\n- [a](b)\n"))
    c = audit.build(
        spark.createDataFrame(sites, "site_id string, start_url string, final_url string"), spark.createDataFrame(fetches, C.FETCHES), spark.createDataFrame(robots, "site_id string, body string, parse_failed boolean"),
        spark.createDataFrame(entries, "site_id string, loc string, lastmod string"), spark.createDataFrame([], "site_id string, error string"), spark.createDataFrame(llms, "site_id string, status int, error string, body string"), F.lit("2025-01-01").cast("timestamp"),
    )
    rows = audit.run(c).persist()
    return c, rows, {(r.site_id, r.check_id): r.status for r in rows.collect()}


def test_a_good_site_passes_all_but_what_cannot_pass(statuses):
    got = {k: s for (n, k), s in statuses[2].items() if n == "good"}
    assert {k for k, s in got.items() if s != "pass"} == {"TRU-001"} and got["TRU-001"] == "warn" and len(got) == 20


@pytest.mark.parametrize(("site", "check", "status"), [
    ("challenge", "ACC-002", "fail"), ("challenge", "ACC-003", "warn"), ("waf", "ACC-002", "fail"), ("waf", "ACC-003", "warn"), ("shell", "REN-001", "fail"), ("shell", "REN-002", "fail"), ("shell", "STR-001", "fail"), ("shell", "STR-004", "fail"),
    ("shell", "SD-001", "fail"), ("shell", "TRU-001", "fail"), ("http", "SITE-001", "fail"), ("down", "ACC-003", "fail"), ("down", "ACC-002", "skip"), ("blocked", "ACC-001", "warn"), ("norobots", "ACC-001", "pass"), ("stale", "DIS-001", "warn"), ("nohsts", "SITE-001", "warn"),
])
def test_faults(statuses, site, check, status):
    assert statuses[2][site, check] == status


def test_scores_and_reports(statuses):
    c, rows, got = statuses
    cats = scoring.category_scores(rows)
    total = {r.site_id: r.overall for r in scoring.overall(cats).collect()}
    assert total["good"] == 100.0 and total["waf"] == round(100 * (100 - 30 - 10) / 100, 1) and all(0 <= x <= 100 for x in total.values())
    assert total["down"] == round(100 * (70 - 20) / 70, 1)  # a skipped check does not count
    assert [r.check_id for r in scoring.top_findings(rows, 2).where("site_id = 'waf'").orderBy("rank").collect()] == ["ACC-002", "ACC-003"]
    for f in report.FORMATS.values():
        assert f(c.sites, rows).where("report is not null").count() == len(SITES)


def test_policies(statuses):
    c = statuses[0]
    for policy, want in (("ignore", "pass"), ("report", "warn"), ("fail", "fail")):
        got = {r.site_id: r.status for r in audit.run(c, policy, only=["acc-001"]).collect()}
        assert got["blocked"] == want and got["good"] == "pass"


def test_selection():
    assert catalog.select(["Access"], ["acc-003"]) == ["ACC-002", "ACC-001"] and len(catalog.select()) == 20 and sum(c[3] for c in fixed.CATALOG) == 100
    with pytest.raises(ValueError):
        catalog.select(["nothing"])


def test_for_page_with_more_questions_than_fit_a_hand_written_file(spark):
    from lensaudit.operators import questions as Q

    rows = spark.range(12_000).selectExpr("concat('q', id) AS question", "CASE WHEN id < 11999 THEN concat('u', id % 2) ELSE 'v' END AS page")
    pages = spark.createDataFrame([("u0",), ("v",), ("w",), (None,)], "url string")
    got = {r.url: r["count"] for r in Q.for_page(rows, pages).groupBy("url").count().collect()}
    assert got == {"u0": 6000, "v": 1, "w": 12_000, None: 12_000}


def test_reports_and_scores_read_written_results(spark):
    """Checks are run once, whatever reads their results."""
    from lensaudit.plans import queries

    got = queries.QUERIES["site_reports"](spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and got.where("version IS NOT NULL").count() == queries.sim.sites(queries._pages(spark, "/root/testdata/sf0.001")).count()
