"""Crawls as a data source: ``spark.read.format("lensaudit")`` and ``spark.readStream.format("lensaudit")``.

    spark.dataSource.register(CrawlSource)
    rows = crawl.classify(spark.read.format("lensaudit").option("plan", "/data/plan").load())

``plan`` is a folder of Parquet files with site_id, url, pos, lens and user_agent. A stream fetches the plan files that
came since its last offset. Other options: ``transport`` (``http``, or ``recorded`` with ``answers``, a folder with url,
status, headers and body), ``partitions``, and delay, concurrency, timeout, max_bytes, redirects and allow_private.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import crawl, fetch

_PLAN = ["site_id", "url", "pos", "lens", "user_agent"]


def _files(path: str) -> list[tuple[int, str]]:
    """(time of the last change, path) of the Parquet files under ``path``, oldest first."""
    fs, p = pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))
    found = fs.get_file_info(pafs.FileSelector(p, recursive=True, allow_not_found=True))
    return sorted((int(f.mtime_ns or 0), f.path) for f in found if f.type == pafs.FileType.File and f.path.endswith(".parquet") and not os.path.basename(f.path).startswith((".", "_")))


@dataclass
class Hosts(InputPartition):
    """The hosts that one task asks: those whose name's CRC is ``part`` modulo ``parts``, in these plan files."""

    part: int
    parts: int
    files: tuple[str, ...]


class _Fetcher:
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        if "plan" not in self.options:
            raise ValueError("the option plan must name a folder")
        self.parts = int(self.options.get("partitions", 8))

    def _split(self, files: list[str]) -> list[Hosts]:
        return [Hosts(i, self.parts, tuple(files)) for i in range(self.parts)] if files else []

    def _mine(self, p: Hosts) -> list[dict]:
        """The partition's rows, first pages of all hosts first."""
        fs, _ = pafs.FileSystem.from_uri(self.options["plan"] if "://" in self.options["plan"] else os.path.abspath(self.options["plan"]))
        rows = []
        for name in p.files:
            with fs.open_input_file(name) as f:
                for b in pq.ParquetFile(f).iter_batches(columns=_PLAN):
                    rows += [r for r in b.to_pylist() if zlib.crc32(urlsplit(r["url"]).netloc.encode()) % p.parts == p.part]
        return sorted(rows, key=lambda r: (r["pos"], r["lens"], r["url"]))

    def read(self, partition: Hosts) -> Iterator[pa.RecordBatch]:
        o = self.options
        limits = fetch.Limits(**{k: kind(o[k]) for k, kind in (("delay", float), ("jitter", float), ("concurrency", int), ("timeout", float), ("max_bytes", int), ("redirects", int)) if k in o}, allow_private=o.get("allow_private", "false").lower() == "true")
        rows = self._mine(partition)
        get, lookup = fetch.http_get, fetch.resolve
        if o.get("transport", "http") == "recorded":
            get, lookup = _recorded(o["answers"]), lambda host: ["93.184.216.34"]
        for got in fetch.schedule(rows, fetch._asker(get, lookup, limits), limits):
            yield pa.RecordBatch.from_pylist([got | {"blocked_by": None, "challenge_marker": None}], fetch._SCHEMA)


def _recorded(path: str) -> fetch.Get:
    """Answers from a table; what is not in it is 404."""
    fs, _ = pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))
    web: dict[str, fetch.Answer] = {}
    for _, name in _files(path):
        with fs.open_input_file(name) as f:
            for r in pq.read_table(f).to_pylist():
                web[r["url"]] = (r["status"], dict(r["headers"] or []), (r["body"] or "").encode())
    return lambda url, headers: web.get(url, (404, {}, b""))


class _Batch(_Fetcher, DataSourceReader):
    def partitions(self):
        return self._split([f for _, f in _files(self.options["plan"])]) or [Hosts(0, 1, ())]


class _Stream(_Fetcher, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": 0, "file": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        files = _files(self.options["plan"])
        return {"at": files[-1][0], "file": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict):
        low, high = (start["at"], start["file"]), (end["at"], end["file"])
        return self._split([f for t, f in _files(self.options["plan"]) if low < (t, f) <= high]) or [Hosts(0, 1, ())]

    def commit(self, end: dict) -> None:
        pass


class CrawlSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lensaudit"

    def schema(self) -> str:
        return crawl.FETCHES

    def reader(self, schema):
        return _Batch(self.options)

    def streamReader(self, schema):  # noqa: N802
        return _Stream(self.options)
