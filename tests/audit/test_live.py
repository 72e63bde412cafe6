import os

import pytest

from lensaudit import cli, config
from lensaudit.sources import live, sitemap

PAGE = b"<html lang=en><head><title>Some title here</title></head><body><h1>H</h1><p>" + b"words and words. " * 100 + b"</p></body></html>"
XML = b'<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">%s</urlset>'


def site(host, pages):
    web = {f"http://{host}/": (200, {}, PAGE)} | {f"http://{host}/p{i}": (200, {}, PAGE) for i in range(pages)}
    web[f"http://{host}/robots.txt"] = (200, {}, f"User-agent: *\nAllow: /\nSitemap: http://{host}/none.xml\nSitemap: http://{host}/index.xml\n".encode())
    web[f"http://{host}/index.xml"] = (200, {}, b"<?xml version='1.0'?><sitemapindex><sitemap><loc>http://%s/c0.xml</loc></sitemap><sitemap><loc>http://%s/c1.xml</loc></sitemap><sitemap><loc>http://%s/c2.xml</loc></sitemap></sitemapindex>" % ((host.encode(),) * 3))
    for c in range(2):
        web[f"http://{host}/c{c}.xml"] = (200, {}, XML % b"".join(f"<url><loc>http://{host}/p{i}</loc><lastmod>2024-05-0{i + 1}</lastmod></url>".encode() for i in range(c, pages, 2)))
    web[f"http://{host}/c2.xml"] = (200, {}, b"<urlset><url>")  # malformed
    return web


def getter(web, log):
    def get(url, headers):
        with open(log, "a") as f:
            f.write(url + "\n")
        return web.get(url, (404, {}, b"gone"))

    return get


def names():
    def lookup(host):  # nested: workers cannot import this module
        return ["10.0.0.1"] if host == "inside.net" else ["93.184.216.34"]

    return lookup


def run(spark, get, *args):
    out = []
    return cli.main(list(args), spark, out.append, get, names()), "\n".join(out)


def test_crawl_then_audit(spark, tmp_path):
    log, snap = str(tmp_path / "log"), str(tmp_path / "snap")
    get = getter(site("a.net", 4) | site("b.net", 1) | {"http://b.net/robots.txt": (500, {}, b"")}, log)
    code, text = run(spark, get, "crawl", "http://a.net/", "http://b.net/", "--output", snap, "--bots", "GPTBot", "--max-pages", "3")
    assert code == 0 and text == "warning: ROBOTS_FETCH: http://b.net/robots.txt: Could not read robots.txt: HTTP 500"
    pages = {(r.site_id, r.pos, r.url) for r in spark.read.parquet(f"{snap}/fetches").collect()}
    # children in order: p0, p2, p1, p3; every second of them; b.net declares nothing and has none of the usual files
    assert pages == {("http://a.net/", 0, "http://a.net/"), ("http://a.net/", 1, "http://a.net/p0"), ("http://a.net/", 2, "http://a.net/p1"), ("http://b.net/", 0, "http://b.net/")}
    assert spark.read.parquet(f"{snap}/entries").count() == 4
    asked = open(log).read().split()
    assert "http://a.net/sitemap.xml" not in asked and "http://b.net/sitemap.xml" in asked  # the first usable one ends the search
    faults = [r.error for r in spark.read.parquet(f"{snap}/faults").collect()]
    assert sum(e is None for e in faults) == 3 and sum("XML parse error" in (e or "") for e in faults) == 1
    before = len(asked)
    code, text = run(spark, get, "crawl", "http://a.net/", "http://b.net/", "--output", snap, "--bots", "GPTBot", "--max-pages", "3")
    assert code == 0 and len(open(log).read().split()) == before  # all answers were there
    text = run(spark, get, "audit", snap)[1]
    assert "http://a.net/  " in text and "/ 100" in text and "WARNING ROBOTS_FETCH  http://b.net/robots.txt" in text and "FAIL  " in text
    assert "## Errors\n\n- ROBOTS_FETCH" in run(spark, get, "audit", snap, "--format", "markdown")[1]
    assert "fetches: " in run(spark, get, "cache", snap)[1]
    run(spark, get, "cache", snap, "--clear")
    assert os.listdir(snap) == []


def test_a_folder_takes_other_crawls(spark, tmp_path):
    """Other start URLs, bots and numbers of pages in one folder: each has its own result, and only what is missing is fetched."""
    log, snap = str(tmp_path / "log"), str(tmp_path / "snap")
    get = getter(site("a.net", 4) | site("b.net", 4), log)
    asked = lambda: open(log).read().split() if os.path.exists(log) else []
    pages = lambda: {(r.url, r.lens) for r in spark.read.parquet(f"{snap}/fetches").collect()}
    first = run(spark, get, "audit", "http://a.net/", "--snapshot", snap, "--bots", "GPTBot", "--max-pages", "2", "--only", "STR-001")[1]
    assert "http://a.net/ " in first and pages() == {(u, b) for u in ("http://a.net/", "http://a.net/p0") for b in ("browser", "GPTBot")}
    n = len(asked())
    assert "http://b.net/ " in run(spark, get, "audit", "http://b.net/", "--snapshot", snap, "--bots", "GPTBot", "--max-pages", "2", "--only", "STR-001")[1]
    assert {u for u, _ in pages()} == {"http://b.net/", "http://b.net/p0"} and {u.split("/")[2] for u in asked()[n:]} == {"b.net"}
    n = len(asked())
    run(spark, get, "crawl", "http://a.net/", "--output", snap, "--bots", "GPTBot,ClaudeBot", "--max-pages", "3")
    assert pages() == {(u, b) for u in ("http://a.net/", "http://a.net/p0", "http://a.net/p1") for b in ("browser", "GPTBot", "ClaudeBot")}
    assert sorted(asked()[n:]) == ["http://a.net/"] + ["http://a.net/p0"] + ["http://a.net/p1"] * 3
    n = len(asked())
    assert run(spark, get, "audit", "http://a.net/", "--snapshot", snap, "--bots", "GPTBot", "--max-pages", "2", "--only", "STR-001")[1] == first and len(asked()) == n
    run(spark, get, "crawl", "http://a.net/", "--output", snap, "--bots", "GPTBot", "--max-pages", "2", "--no-cache")
    assert len(asked()) - n == 1 + 2 + 3 + 4 + 1  # robots.txt, two candidates, three children, two pages by two, llms.txt


def test_old_answers_and_failures_are_fetched_again(spark, tmp_path):
    from lensaudit.sources import fetch

    log = str(tmp_path / "log")
    kept, plan = live.answers(str(tmp_path / "s")), spark.createDataFrame([("a", "http://a.net/x", 0, "browser", "ua"), ("b", "http://a.net/x", 3, "browser", "ua"), ("a", "http://a.net/y", 1, "browser", "ua")], "site_id string, url string, pos int, lens string, user_agent string")
    get, quick = getter({"http://a.net/x": (200, {}, b"one")}, log), fetch.Limits(delay=0.0)
    dead = lambda url, headers: 1 / 0
    rows = fetch.through(kept, plan.where("url LIKE '%y'"), dead, names(), quick).collect()
    assert rows[0].error.startswith("ZeroDivisionError")
    rows = fetch.through(kept, plan, get, names(), quick)
    assert {(r.site_id, r.pos, r.url[-1], r.status, r.body) for r in rows.collect()} == {("a", 0, "x", 200, "one"), ("b", 3, "x", 200, "one"), ("a", 1, "y", 404, "gone")}
    assert open(log).read().split().count("http://a.net/x") == 1  # asked for by two sites
    other = getter({"http://a.net/x": (200, {}, b"two")}, log)
    assert {r.body for r in fetch.through(kept, plan, other, names(), quick, most_seconds=3600).collect()} == {"one", "gone"}
    assert {r.body for r in fetch.through(kept, plan, other, names(), quick, most_seconds=0).collect()} == {"two", "gone"}
    assert fetch.through(kept, plan, dead, names(), fetch.Limits(max_bytes=2)).where("error IS NULL").count() == 0  # other limits, another key


def test_a_task_goes_on_behind_its_last_commit(spark, tmp_path):
    """The first attempt of a task is lost after some commits."""
    from lensaudit.sources import store

    log, flag = str(tmp_path / "log"), str(tmp_path / "flag")
    kept = store.Store(str(tmp_path / "s"), "twice long")

    def make(rows):
        import os

        for n, r in enumerate(rows):
            if n == 7 and not os.path.exists(flag):
                open(flag, "w").close()
                raise MemoryError
            with open(log, "a") as f:
                f.write(r["key"] + "\n")
            yield {"key": r["key"], "twice": 2 * r["i"]}

    todo = spark.range(10).selectExpr("CAST(id AS string) AS key", "id AS i").coalesce(1)
    todo.write.parquet(str(tmp_path / "todo"))
    again = spark.read.parquet(str(tmp_path / "todo"))
    with pytest.raises(Exception, match="MemoryError"):
        kept.fill(again, make, every=1, run="r")
    assert kept.newest(spark).count() == 7
    assert kept.fill(again, make, every=1, total="twice", run="r") == (3, 2 * (7 + 8 + 9))
    assert sorted(open(log).read().split()) == sorted(map(str, range(10)))
    assert {(r.key, r.twice) for r in kept.newest(spark).collect()} == {(str(i), 2 * i) for i in range(10)}
    assert kept.missing(spark.createDataFrame([("3",), ("x",)], "key string")).collect() == [("x",)]
    assert kept.size() > 0 and kept.clear(spark) > 0 and kept.newest(spark).count() == 0 == kept.clear(spark)


def test_audit_of_a_url(spark, tmp_path):
    get = getter(site("a.net", 2), str(tmp_path / "log"))
    assert run(spark, get, "audit", "http://a.net/")[0] == 2
    code, text = run(spark, get, "audit", "http://a.net/", "--snapshot", str(tmp_path / "s"), "--bots", "GPTBot", "--only", "STR-001", "--format", "json")
    assert code == 0 and '"status":"pass"' in text or '"status":"warn"' in text


def test_refused_and_lost_sites_have_codes(spark, tmp_path):
    get = getter({}, str(tmp_path / "log"))
    code, text = run(spark, get, "crawl", "http://inside.net/", "--output", str(tmp_path / "i"), "--bots", "GPTBot")
    assert code == 6 and "BLOCKED_TARGET" in text and not os.path.exists(tmp_path / "log")
    code, text = run(spark, get, "crawl", "http://lost.net/", "--output", str(tmp_path / "l"), "--bots", "GPTBot")
    assert code == 3 and "FETCH_FAILED" in text


def test_no_sites(spark, tmp_path):
    live.snapshot(spark, spark.createDataFrame([], "site_id string, start_url string"), str(tmp_path / "e"), bots=["GPTBot"], lookup=names())
    assert spark.read.parquet(f"{tmp_path}/e/fetches").count() == 0 and sorted(["_fetched", *os.listdir(tmp_path / "e")]) == sorted(live.TABLES)  # nothing was fetched


@pytest.mark.parametrize("span", [1, 3, 65_536])
def test_samples_do_not_depend_on_the_stretches(spark, span, monkeypatch):
    monkeypatch.setattr(sitemap, "SPAN", span)
    rows = [("s", "http://s/", i * 2, f"http://s/{i}") for i in range(23)] + [("s", "http://s/", 100, "http://s")]
    got = sitemap.sample(spark.createDataFrame(rows, "site_id string, start_url string, pos long, url string"), 5).orderBy("ord").collect()
    assert [(r.ord, r.url) for r in got] == [(0, "http://s/")] + [(k + 1, f"http://s/{k * 5}") for k in range(4)]


def test_settings_files(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert cli.main(["init"], None, lambda s: None) == 0 and cli.main(["init"], None, lambda s: None) == 2
    assert config.load(None, {}) == config.Config()  # the starter file says what holds anyway
    os.makedirs(tmp_path / "home/lensaudit")
    (tmp_path / "home/lensaudit/config.toml").write_text("[audit]\nmax_pages = 7\npolicy = 'fail'\n")
    (tmp_path / "lensaudit.toml").write_text("[audit]\nmax_pages = 8\n")
    cfg = config.load(None, {"XDG_CONFIG_HOME": str(tmp_path / "home"), "LENSAUDIT_POLICY": "ignore"})
    assert (cfg.audit.max_pages, cfg.audit.policy) == (8, "ignore") and len(cfg.sources) == 4
