"""Live fetching of a plan (see ``crawl.lens_urls``) into snapshot rows.

A host gets one request at a time, with a pause between two; in each task many hosts are served
side by side, the one that may be asked soonest first. The transport is injected, so that
tests and recorded crawls need no network. Every failure is a row with an error.
"""

from __future__ import annotations

import heapq
import http.client
import ipaddress
import random
import socket
import ssl
import time
import zlib
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor
from concurrent.futures import wait as wait_for
from dataclasses import dataclass
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text, urls
from . import crawl, store

MAX_BYTES, MAX_REDIRECTS, TIMEOUT, DELAY = 5_000_000, 5, 15.0, 0.2
#: Rows a task looks ahead for hosts that may be asked.
AHEAD = 10_000
_BLOCKED = [ipaddress.ip_network(n) for n in (*fixed.BLOCKED_V4, *fixed.BLOCKED_V6)]

Answer = tuple[int, dict[str, str], bytes]
Get = Callable[[str, dict], Answer]
Lookup = Callable[[str], list[str]]


@dataclass(frozen=True)
class Limits:
    """How a crawl treats hosts: seconds between two requests to one (and up to half as many more, by
    chance), requests a task has open, seconds and bytes of an answer, redirects; whether private
    addresses may be asked."""

    delay: float = DELAY
    jitter: float = 0.5
    concurrency: int = 4
    timeout: float = TIMEOUT
    max_bytes: int = MAX_BYTES
    redirects: int = MAX_REDIRECTS
    allow_private: bool = False


def http_get(url: str, headers: dict[str, str], address: str | None = None, limits: Limits = Limits()) -> Answer:  # noqa: B008
    """One GET without following redirects, over a connection to ``address``, which was checked, whatever
    the name resolves to by now. Certificates are still checked against the name."""
    parts = urlsplit(url)
    port = parts.port or (443 if parts.scheme == "https" else 80)
    link = http.client.HTTPConnection(parts.hostname, port, timeout=limits.timeout)
    raw = socket.create_connection((address or parts.hostname, port), limits.timeout)
    try:
        link.sock = ssl.create_default_context().wrap_socket(raw, server_hostname=parts.hostname) if parts.scheme == "https" else raw
        link.request("GET", (parts.path or "/") + (f"?{parts.query}" if parts.query else ""), headers=headers | {"Host": parts.netloc.rpartition("@")[2], "Connection": "close"})
        r = link.getresponse()
        return r.status, dict(r.getheaders()), r.read(limits.max_bytes + 1)
    finally:
        link.close()
        raw.close()


http_get.checked = True  # takes the address that was checked, and the limits


def resolve(host: str) -> list[str]:
    return sorted({x[4][0] for x in socket.getaddrinfo(host, None, proto=socket.IPPROTO_TCP)})


def _checked(url: str, lookup: Lookup, allow_private: bool) -> tuple[str | None, str | None]:
    """(why ``url`` may not be fetched, the address to ask)."""
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https") or not parts.hostname:
        return f"blocked: {parts.scheme or 'no'} scheme", None
    try:
        found = [ipaddress.ip_address(parts.hostname)]
    except ValueError:
        try:
            found = [ipaddress.ip_address(a) for a in lookup(parts.hostname)]
        except (OSError, UnicodeError, ValueError) as e:
            return f"blocked: {parts.hostname} does not resolve: {e}", None
    found = [getattr(a, "ipv4_mapped", None) or a for a in found]  # ::ffff:10.0.0.1 is 10.0.0.1
    bad = [] if allow_private else [str(a) for a in found if any(a.version == n.version and a in n for n in _BLOCKED)]
    return (f"blocked: {parts.hostname} is {bad[0]}" if bad else None), (str(found[0]) if found else None)


def guard(url: str, lookup: Lookup = resolve, allow_private: bool = False) -> str | None:
    """Why ``url`` may not be fetched: its scheme, or any address of its host; None if it may."""
    return _checked(url, lookup, allow_private)[0]


def fetch_one(url: str, user_agent: str, simulated: bool, get: Get, lookup: Lookup = resolve, limits: Limits = Limits()) -> dict:  # noqa: B008
    """Status, headers, body, final URL, redirects and error of one fetch."""
    headers = {"User-Agent": user_agent, "Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8", "Accept-Language": "en;q=0.9"}
    if simulated:
        headers["X-Audit-Test"] = "1"  # test traffic says what it is
    error, address = _checked(url, lookup, limits.allow_private)
    out = {"final_url": url, "status": None, "headers": {}, "body": None, "error": error, "redirect_chain": []}
    try:
        while out["error"] is None:
            status, got, body = get(out["final_url"], headers, address, limits) if getattr(get, "checked", False) else get(out["final_url"], headers)
            got = {k.lower(): v for k, v in got.items()}
            out |= {"status": status, "headers": got}
            to = got.get("location")
            if status in fixed.REDIRECT_STATUS and to and len(out["redirect_chain"]) <= limits.redirects:
                to = urljoin(out["final_url"], to)
                out["redirect_chain"].append({"from": out["final_url"], "status": status, "to": to})
                if len(out["redirect_chain"]) > limits.redirects:
                    break
                out["error"], address = _checked(to, lookup, limits.allow_private)
                out["final_url"] = to
                continue
            if body[:2] == b"\x1f\x8b":  # a packed file, such as sitemap.xml.gz
                body = zlib.decompressobj(31).decompress(body, limits.max_bytes + 1)
            out["body"] = body[: limits.max_bytes].decode("utf-8", "replace")
            if len(body) > limits.max_bytes:
                out["error"] = f"response truncated at {limits.max_bytes} bytes"
            break
    except Exception as e:  # noqa: BLE001 - a failed fetch is a row, whatever the transport raises
        out["error"] = f"{type(e).__name__}: {e}"
    return out


class Clock:
    """Time, and a pool that asks; tests put others in its place."""

    now = staticmethod(time.monotonic)

    def pool(self, n: int):
        return ThreadPoolExecutor(n)

    def wait(self, asked: set[Future], seconds: float | None) -> set[Future]:
        if not asked:
            time.sleep(seconds or 0)
            return set()
        return wait_for(asked, seconds, FIRST_COMPLETED)[0]


def schedule(rows: Iterable[dict], ask: Callable[[dict], dict], limits: Limits, until: Callable[[dict], bool] | None = None, clock: Clock | None = None) -> Iterator[dict]:
    """Answers of ``ask`` to ``rows`` (url, site_id, ...) as they come. A host's rows are asked in their order,
    one at a time, each ``delay`` after the last answer; of the hosts that may be asked, that
    which has waited longest is next. After an answer that ``until`` holds for, the rest of its site is
    left out. At most AHEAD rows are read ahead."""
    clock = clock or Clock()
    rows, ended = iter(rows), False
    waiting: dict[str, deque[dict]] = {}
    ready: list[tuple[float, int, str]] = []  # hosts with rows and no open request, by the time they may be asked
    free: dict[str, float] = {}  # when a host without rows may be asked again
    busy: dict[Future, tuple[str, dict]] = {}
    left = turn = 0
    done: set[str] = set()
    with clock.pool(limits.concurrency) as pool:
        while True:
            while not ended and left < AHEAD:
                row = next(rows, None)
                if row is None:
                    ended = True
                    break
                host = urlsplit(row["url"]).netloc.rpartition("@")[2]
                if host not in waiting:
                    waiting[host] = deque()
                    heapq.heappush(ready, (free.pop(host, 0.0), turn := turn + 1, host))
                waiting[host].append(row)
                left += 1
            if not left and not busy:
                return
            while ready and len(busy) < limits.concurrency and ready[0][0] <= clock.now():
                _, _, host = heapq.heappop(ready)
                line = waiting[host]
                while line and line[0]["site_id"] in done:
                    line.popleft()
                    left -= 1
                if line:
                    row = line.popleft()
                    left -= 1
                    busy[pool.submit(_timed, ask, row, clock)] = (host, row)
                else:
                    del waiting[host]
                    free[host] = clock.now()
            pause = max(0.0, ready[0][0] - clock.now()) if ready and len(busy) < limits.concurrency else None
            if not busy and pause is None:
                continue
            for f in clock.wait(set(busy), pause):
                host, row = busy.pop(f)
                got = f.result()
                chance = random.Random(f"{host} {row['url']} {row.get('lens')}").random()
                again = clock.now() + limits.delay * (1 + limits.jitter * chance)
                if waiting[host]:
                    heapq.heappush(ready, (again, turn := turn + 1, host))
                else:
                    del waiting[host]
                    free[host] = again
                    if len(free) > AHEAD:
                        free = {h: t for h, t in free.items() if t > clock.now()}
                if until and until(got):
                    done.add(row["site_id"])
                yield got


def _timed(ask: Callable[[dict], dict], row: dict, clock: Clock) -> dict:
    began = clock.now()
    got = ask(row)
    return got | {"elapsed_ms": int((clock.now() - began) * 1000)}


_SCHEMA = pa.schema([
    ("site_id", pa.string()), ("url", pa.string()), ("pos", pa.int32()), ("lens", pa.string()), ("final_url", pa.string()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.string()), ("elapsed_ms", pa.int32()), ("error", pa.string()), ("blocked_by", pa.string()),
    ("redirect_chain", pa.list_(pa.struct([("from", pa.string()), ("status", pa.int32()), ("to", pa.string())]))), ("challenge_marker", pa.string()),
])


def _asker(get: Get, lookup: Lookup, limits: Limits) -> Callable[[dict], dict]:
    def ask(r: dict) -> dict:
        got = fetch_one(r["url"], r["user_agent"], r["lens"] != "browser", get, lookup, limits)
        return {k: r[k] for k in ("site_id", "url", "pos", "lens")} | got | {"headers": list(got["headers"].items())}

    return ask


def dealt(plan: DataFrame, *more: str) -> DataFrame:
    """``plan`` (site_id, url, pos, lens, user_agent) with the rows of a host in one task, first pages of all hosts first."""
    rows = plan.select("site_id", "url", F.col("pos").cast("int").alias("pos"), "lens", "user_agent", *more).withColumn("_host", urls.netloc(F.col("url")))
    return rows.repartition("_host").sortWithinPartitions("pos", "lens", "_host").drop("_host")


def fetch(plan: DataFrame, get: Get = http_get, lookup: Lookup = resolve, limits: Limits = Limits(), until: Callable[[dict], bool] | None = None) -> DataFrame:  # noqa: B008
    """Snapshot rows of ``plan``. With ``until``, the rows of a site are fetched by pos up to the first
    that it holds for; they must have one host."""

    def run(batches):
        rows = (r for b in batches for r in b.to_pylist())
        for got in schedule(rows, _asker(get, lookup, limits), limits, until):
            yield pa.RecordBatch.from_pylist([got | {"blocked_by": None, "challenge_marker": None}], _SCHEMA)

    return crawl.classify(dealt(plan).mapInArrow(run, crawl.FETCHES))


#: What the store of fetches keeps of an answer.
KEPT = "final_url string, status int, headers map<string,string>, body string, elapsed_ms int, error string, redirect_chain array<struct<from: string, status: int, to: string>>"


def key(limits: Limits) -> Column:
    """Key of a fetch: the URL by a user agent, and what else decides on the answer."""
    settings = (limits.max_bytes, limits.redirects, limits.allow_private)
    return text.cache_key(F.lit("fetch"), F.col("url"), F.col("lens"), F.col("user_agent"), *(F.lit(str(x)) for x in settings))


def through(kept: store.Store, plan: DataFrame, get: Get = http_get, lookup: Lookup = resolve, limits: Limits = Limits(), until: Callable[[dict], bool] | None = None, usable: Column | None = None, most_seconds: float | None = None) -> DataFrame:  # noqa: B008
    """Snapshot rows of ``plan`` from what ``kept`` has, after what it lacks was fetched and kept.

    Fetches that got no answer are tried again, as are those older than ``most_seconds``. With ``until`` (and
    ``usable``, the same of a column), what comes behind a known answer it holds for is not fetched.
    """
    spark = plan.sparkSession
    keyed = plan.select("site_id", "url", F.col("pos").cast("int").alias("pos"), "lens", "user_agent").withColumn("key", key(limits))
    answered = F.col("status").isNotNull() | F.col("error").startswith("blocked:")
    todo = kept.missing(keyed, answered, most_seconds)
    if until:
        known = keyed.join(kept.newest(spark, most_seconds).where(usable).select("key"), "key")
        first = known.groupBy("site_id").agg(F.min("pos").alias("_first"))
        todo = todo.join(first, "site_id", "left").where(F.col("_first").isNull() | (F.col("pos") < F.col("_first"))).drop("_first")
    # two sites may ask for the same URL: it is fetched once
    once = todo.groupBy("key").agg(F.min(F.struct("site_id", "pos", "url", "lens", "user_agent")).alias("r")).select("key", "r.*") if not until else todo
    ask = _asker(get, lookup, limits)

    def make(rows: Iterator[dict]) -> Iterator[dict]:
        keys: dict[tuple, str] = {}

        def named():
            for r in rows:
                keys[r["url"], r["lens"], r["site_id"], r["pos"]] = r["key"]
                yield r

        for got in schedule(named(), ask, limits, until):
            yield {"key": keys.pop((got["url"], got["lens"], got["site_id"], got["pos"]))} | {k: got[k] for k in ("final_url", "status", "headers", "body", "elapsed_ms", "error", "redirect_chain")}

    kept.fill(dealt(once, "key"), make)
    rows = keyed.join(kept.newest(spark), "key").withColumns({"blocked_by": F.lit(None).cast("string"), "challenge_marker": F.lit(None).cast("string")})
    return crawl.classify(rows.select(*_SCHEMA.names))
