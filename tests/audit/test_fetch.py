from lensaudit.operators import providers
from lensaudit.sources import crawl, fetch

WEB = {"http://a.net/": (301, {"Location": "/b"}, b""), "http://a.net/b": (200, {"X": "y"}, b"ok \xff"), "http://a.net/loop": (302, {"location": "/loop"}, b""), "http://a.net/in": (302, {"location": "http://10.0.0.1/"}, b""), "http://a.net/big": (200, {}, b"x" * 50), "http://a.net/no": (403, {}, b"")}
PUBLIC = lambda host: ["93.184.216.34"]


def get(url, headers):
    assert headers["User-Agent"] and url in WEB, url
    return WEB[url]


def one(path, **kw):
    return fetch.fetch_one(f"http://a.net/{path}", "ua", True, get, PUBLIC, **kw)


def test_redirects_limits_and_failures():
    got = one("")
    assert (got["status"], got["final_url"], got["body"], got["headers"]) == (200, "http://a.net/b", "ok �", {"x": "y"}) and len(got["redirect_chain"]) == 1
    assert one("loop")["status"] == 302 and len(one("loop")["redirect_chain"]) == fetch.MAX_REDIRECTS + 1
    assert "10.0.0.1" in one("in")["error"] and "truncated" in one("big", limits=fetch.Limits(max_bytes=10))["error"] and len(one("big", limits=fetch.Limits(max_bytes=10))["body"]) == 10
    assert one("gone")["error"].startswith("AssertionError")


def test_guard():
    assert fetch.guard("http://x.net/", PUBLIC) is None
    for url in ("ftp://x.net/", "http://127.0.0.1/", "http://[::1]/", "http://[::ffff:127.0.0.1]/", "http://", "http://169.254.169.254/x"):
        assert fetch.guard(url, PUBLIC)
    assert fetch.guard("http://x.net/", lambda h: ["8.8.8.8", "192.168.0.1"]) and fetch.guard("http://x.net/", lambda h: ["nope"])


def test_a_plan_becomes_snapshot_rows(spark):
    pages = spark.createDataFrame([("a", "http://a.net/", 0), ("a", "http://a.net/no", 1)], "site_id string, url string, pos int")
    web = dict(WEB)  # workers get what nested functions refer to, not this module
    rows = fetch.fetch(crawl.lens_urls(pages, crawl.bots(spark, ["GPTBot"])), lambda url, headers: web[url], lambda host: ["93.184.216.34"], fetch.Limits(delay=0.0)).collect()
    assert sorted((r.lens, r.pos, r.status, r.blocked_by, r.error) for r in rows) == [(lens, p, s, b, e) for lens in ("GPTBot", "browser") for p, s, b, e in ((0, 200, None, None), (1, 403, "waf", "HTTP 403"))]


def test_providers():
    assert providers.detect({}) is None and providers.detect({"GEMINI_API_KEY_2": "x", "GROQ_API_KEY": "y"})[0] == "GROQ_API_KEY"
    assert providers.detect({"NVIDIA_API_KEY_1": "x", "GEMINI_API_KEY_1": "y"})[0] == "GEMINI_API_KEY"


class Fake(fetch.Clock):
    """Time that passes by waiting and asking only; requests end one by one."""

    def __init__(self):
        self.t, self.open, self.most = 0.0, [], 0

    def now(self):
        return self.t

    def pool(self, n):
        return self

    def __enter__(self):
        return self

    def __exit__(self, *a):
        pass

    def submit(self, run, ask, row, clock):
        from concurrent.futures import Future

        f = Future()
        self.open.append((self.t + 1.0, f, run, ask, row))
        self.most = max(self.most, len(self.open))
        return f

    def wait(self, asked, seconds):
        ends = min((x[0] for x in self.open), default=float("inf"))
        until = self.t + seconds if seconds is not None else float("inf")
        self.t = min(ends, until)
        done = set()
        for x in [x for x in self.open if x[0] <= self.t]:
            self.open.remove(x)
            x[1].set_result(x[2](x[3], x[4], self))
            done.add(x[1])
        return done


def _rows(hosts, each):
    return [{"site_id": f"s{h}", "url": f"http://h{h}/{i}", "pos": i, "lens": "browser"} for i in range(each) for h in range(hosts)]


def test_hosts_do_not_wait_for_each_other():
    clock, asked = Fake(), []

    def ask(row):
        asked.append((clock.t, row["url"]))
        return dict(row)

    limits = fetch.Limits(delay=3.0, jitter=0.5, concurrency=50)
    got = list(fetch.schedule(_rows(50, 4), ask, limits, clock=clock))
    assert len(got) == 200 and clock.most == 50
    assert clock.t <= 4 * 1.0 + 3 * 4.5  # one host's time: a second each, at most 4.5 between
    for h in range(50):
        mine = [t for t, u in asked if u.startswith(f"http://h{h}/")]
        assert [u for _, u in asked if u.startswith(f"http://h{h}/")] == [f"http://h{h}/{i}" for i in range(4)]
        assert all(4.0 <= b - a <= 5.5 for a, b in zip(mine, mine[1:]))  # an answer's second, then 3 to 4.5
    clock.t, clock.most = 0.0, 0
    list(fetch.schedule(_rows(50, 4), lambda r: dict(r), fetch.Limits(delay=0.0, concurrency=4), clock=clock))
    assert clock.most == 4


def test_a_host_is_spared_also_when_its_rows_come_late(monkeypatch):
    monkeypatch.setattr(fetch, "AHEAD", 1)
    clock, asked = Fake(), []
    rows = [{"site_id": "s", "url": f"http://h{i % 2}/{i}", "pos": i, "lens": "x"} for i in range(6)]
    got = list(fetch.schedule(rows, lambda r: asked.append((clock.t, r["url"])) or dict(r), fetch.Limits(delay=10.0, jitter=0.0), clock=clock))
    assert len(got) == 6
    for h in "01":
        mine = [t for t, u in asked if u.startswith(f"http://h{h}/")]
        assert all(b - a >= 10.0 for a, b in zip(mine, mine[1:]))


def test_the_rest_of_a_site_is_left_out():
    rows = [{"site_id": s, "url": f"http://{s}/{i}", "pos": i, "lens": "x"} for i in range(4) for s in "ab"]
    got = list(fetch.schedule(rows, lambda r: dict(r), fetch.Limits(delay=0.0), lambda r: r["url"] == "http://a/1", Fake()))
    assert sorted(r["url"] for r in got) == ["http://a/0", "http://a/1", "http://b/0", "http://b/1", "http://b/2", "http://b/3"]


def test_many_hosts_in_two_tasks(spark):
    """Fifty hosts, three pages each, 0.4 seconds between: one after another they would take a minute."""
    import time

    rows = [(f"s{h}", f"http://h{h}.net/{i}", i, "browser", "ua") for h in range(50) for i in range(3)]
    plan = spark.createDataFrame(rows, "site_id string, url string, pos int, lens string, user_agent string")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        began = time.time()
        got = fetch.fetch(plan, lambda url, headers: (200, {}, b"ok"), lambda host: ["93.184.216.34"], fetch.Limits(delay=0.4, concurrency=8)).collect()
        assert len(got) == 150 and time.time() - began < 20
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_the_connection_goes_to_the_checked_address():
    """A name that resolves to something else by the time of the request."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Page(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            body = f"{self.headers['Host']} {self.path}".encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Page)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://no-such-name.invalid:{server.server_port}/x?y=1"
        names = iter([["127.0.0.1"], ["10.0.0.9"]])
        got = fetch.fetch_one(url, "ua", False, fetch.http_get, lambda host: next(names), fetch.Limits(allow_private=True))
        assert (got["status"], got["body"]) == (200, f"no-such-name.invalid:{server.server_port} /x?y=1")
        assert "10.0.0.9" in fetch.fetch_one(url, "ua", False, fetch.http_get, lambda host: next(names))["error"]
    finally:
        server.shutdown()


def test_packed_answers_are_unpacked():
    import gzip

    web = {"http://a.net/s.gz": (200, {}, gzip.compress(b"<urlset/>"))}
    assert fetch.fetch_one("http://a.net/s.gz", "ua", False, lambda u, h: web[u], PUBLIC)["body"] == "<urlset/>"
