"""Sitemaps: candidates, reading, sampling and the report of a site."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import dates, urls

#: Places that one task numbers at once.
SPAN = 65_536
#: Bytes given to the parser, and rows given to Spark, at once.
STEP, ROWS = 1 << 16, 4096
READ = "kind string, i long, loc string, lastmod string, error string"
_TABLE = pa.schema([("kind", pa.string()), ("i", pa.int64()), ("loc", pa.string()), ("lastmod", pa.string()), ("error", pa.string())])


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _steps(body: memoryview | bytes) -> Iterator[bytes]:
    """The file in parts, unpacked if it is gzip."""
    if bytes(body[:2]) != b"\x1f\x8b":
        yield from (bytes(body[a : a + STEP]) for a in range(0, len(body), STEP))
        return
    at, unpack = 0, zlib.decompressobj(31)
    while at < len(body) or unpack.unconsumed_tail:
        part = unpack.unconsumed_tail or bytes(body[at : (at := at + STEP)])
        yield unpack.decompress(part, STEP)
        if unpack.eof:
            return


def _fault(body: memoryview | bytes) -> str | None:
    """Why the file is no XML; None if it is."""
    parser = expat.ParserCreate(namespace_separator="}")
    try:
        for part in _steps(body):
            parser.Parse(part, False)
        parser.Parse(b"", True)
    except (expat.ExpatError, zlib.error) as e:
        return f"XML parse error: {e}"
    return None


def scan(body: memoryview | bytes | None) -> Iterator[tuple[str, int, str | None, str | None, str | None]]:
    """(kind, i, loc, lastmod, error) of one file, in order: a ``file`` with its fault, if any, then each
    ``entry`` of a sitemap or ``child`` of an index. A file with a fault has neither. Read twice in
    steps; only the element at hand is held."""
    fault = _fault(body or b"")
    yield "file", 0, None, None, fault
    if fault:
        return
    parser, path, index, n = ElementTree.XMLPullParser(("start", "end")), [], False, 0
    for part in _steps(body):
        parser.feed(part)
        for event, node in parser.read_events():
            tag = _local(node.tag)
            if event == "start":
                index = index or (not path and tag == "sitemapindex")
                path.append(node)
                continue
            path.pop()
            if tag in ("url", "sitemap"):
                text = lambda name, node=node: next((c.text.strip() for c in node if _local(c.tag) == name and c.text), None)
                if (loc := text("loc")) and (tag == "url" or index):
                    yield ("entry" if tag == "url" else "child"), n, loc, (text("lastmod") if tag == "url" else None), None
                    n += 1
            if len(path) < 2 or tag in ("url", "sitemap"):
                node.clear()
                if path:
                    path[-1].remove(node)


def read(files: DataFrame, by: list[str], body: str = "body") -> DataFrame:
    """``by``, kind, i, loc, lastmod and error of sitemap files of any size (text or bytes, gzip too): a row
    for each file, entry and child (see ``scan``). Null and empty bodies are files with a fault; repeated
    files are read each; an empty table gives an empty one."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                value = b.column("_body")[i]
                held: list[tuple] = []
                for row in scan(memoryview(value.as_buffer()) if value.is_valid else None):
                    held.append(row)
                    if len(held) == ROWS:
                        yield _rows(b, i, held)
                        held = []
                yield _rows(b, i, held)

    def _rows(b: pa.RecordBatch, i: int, held: list[tuple]) -> pa.RecordBatch:
        keys = b.select(by).take(pa.array([i] * len(held), pa.int64()))
        cols = [pa.array(c, f.type) for c, f in zip(zip(*held), _TABLE)] if held else [pa.nulls(0, f.type) for f in _TABLE]
        return pa.RecordBatch.from_arrays([*keys.columns, *cols], [*by, *_TABLE.names])

    rows = files.select(*by, F.col(body).cast("binary").alias("_body"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in by)
    return rows.mapInArrow(run, f"{kept}, {READ}")


#: What one of the first 400 characters of a sitemap has, or begins with.
_BEGINS, _HAS, _HEAD = "<?xml", ("<urlset", "<sitemapindex"), 400


def is_sitemap(body: str | None) -> bool:
    """The same as ``looks_like_sitemap``, of a value."""
    head = (body or "")[:_HEAD].lstrip().lower()
    return head.startswith(_BEGINS) or any(x in head for x in _HAS)


def looks_like_sitemap(body: Column) -> Column:
    """By its first characters."""
    head = F.lower(F.regexp_replace(F.substring(F.coalesce(body, F.lit("")), 1, _HEAD), r"(?U)^\s+", ""))
    return head.startswith(_BEGINS) | F.contains(head, F.lit(_HAS[0])) | F.contains(head, F.lit(_HAS[1]))


def candidates(sites: DataFrame, declared: DataFrame) -> DataFrame:
    """(site_id, ord, url) to try: same-origin ones that robots.txt names, then the usual
    paths; each once, in the order of their first mention."""
    root = F.concat(urls.scheme(F.col("start_url")), F.lit("://"), urls.netloc(F.col("start_url")))
    usual = sites.select("site_id", F.posexplode(F.array(*(F.concat(root, F.lit(p)) for p in fixed.SITEMAP_PATHS))).alias("pos", "url")).withColumn("src", F.lit(1))
    named = declared.join(sites, "site_id").where(urls.same_origin(F.col("url"), F.col("start_url"))).select("site_id", "pos", "url", F.lit(0).alias("src"))
    first = named.unionByName(usual).groupBy("site_id", "url").agg(F.min(F.struct("src", "pos")).alias("o"))
    return first.select("site_id", (F.row_number().over(Window.partitionBy("site_id").orderBy("o")) - 1).alias("ord"), "url")


def sample(pages: DataFrame, most: int) -> DataFrame:
    """The start URL and an even spread of the other listed URLs, at most ``most`` to a site.

    ``pages``: site_id, start_url, pos, url. Every ``step``-th other URL is taken from the
    first, with ``step`` the count over ``most - 1``. URLs are numbered by stretches of SPAN places,
    so that a site of any size is numbered by many tasks; ``pos`` is a whole number.
    """
    rest = most - 1
    other = pages.where(urls.bare(F.col("url")) != urls.bare(F.col("start_url")))
    other = other.withColumn("part", F.expr(f"pos div {SPAN}"))
    site = Window.partitionBy("site_id")
    so_far = F.sum("m").over(site.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    parts = other.groupBy("site_id", "part").agg(F.count(F.lit(1)).alias("m"))
    parts = parts.select("site_id", "part", (so_far - F.col("m")).alias("before"), F.sum("m").over(site).alias("n"))
    place = F.row_number().over(Window.partitionBy("site_id", "part").orderBy("pos")) - 1
    other = other.withColumn("place", place).join(parts, ["site_id", "part"]).withColumn("rn", F.col("before") + F.col("place"))
    step = F.greatest(F.lit(1), F.expr(f"n div {max(rest, 1)}"))
    picked = other.where((F.col("rn") % step == 0) & (F.floor(F.col("rn") / step) < rest)).select("site_id", (F.floor(F.col("rn") / step) + 1).cast("int").alias("ord"), "url")
    start = pages.select("site_id", F.lit(0).alias("ord"), F.col("start_url").alias("url")).distinct()
    return start.unionByName(picked)


def report(sites: DataFrame, entries: DataFrame, errors: DataFrame, now: Column) -> DataFrame:
    """Sitemap report of each site: found, url_count, parse_errors, includes_start_url, stale.

    ``entries``: site_id, loc, lastmod; ``errors``: site_id, error, a row for each fault
    while reading; both have a row for a site only where a sitemap was found. URLs of
    another origin, and stale dates, add an error each as a whole.
    """
    own = entries.join(sites, "site_id")
    on = urls.same_origin(F.col("loc"), F.col("start_url"))
    stale = dates.is_stale(F.col("lastmod"), now)
    agg = own.groupBy("site_id").agg(
        F.count_if(on).alias("url_count"), F.count_if(~on).alias("cross"), F.count_if(stale).alias("stale"),
        F.coalesce(F.bool_or(on & (urls.bare(F.col("loc")) == urls.bare(F.col("start_url")))), F.lit(False)).alias("includes_start_url"),
    )
    faults = errors.groupBy("site_id").agg(F.count("error").alias("faults"))
    out = sites.select("site_id").join(agg, "site_id", "left").join(faults, "site_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    return out.select("site_id", (F.col("url_count").isNotNull() | F.col("faults").isNotNull()).alias("found"), n("url_count").alias("url_count"), (n("faults") + (n("cross") > 0).cast("long") + (n("stale") > 0).cast("long")).alias("parse_errors"), F.coalesce("includes_start_url", F.lit(False)).alias("includes_start_url"), n("stale").alias("stale"))
