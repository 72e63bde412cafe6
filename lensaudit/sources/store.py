"""Rows that cost much to make (fetches, model calls), kept by key in a shared folder.

What is known is read, only what is missing is made, and tasks commit what they made batch by
batch, in files of their own: a task that is run again after an executor was lost goes on behind
the last batch. The newest row of a key holds.
"""

from __future__ import annotations

import io
import os
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows that a task makes before it commits them.
EVERY = 16

Make = Callable[[Iterator[dict]], Iterable[dict]]


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def _full(schema: str) -> StructType:
    return _parse_datatype_string(f"key string, made_at double, {schema}")


class Store:
    """The rows under ``path``: key, made_at (seconds) and the columns of ``schema``."""

    def __init__(self, path: str, schema: str):
        self.path, self.schema = path.rstrip("/"), schema

    def all(self, spark: SparkSession) -> DataFrame:
        """Every row that was ever committed; none where the folder is missing.

        The folders of all runs are named one by one: Spark takes two reads of one folder for the same,
        and would let a query that joins an earlier and a later read use one of them for both."""
        fs, p = _fs(self.path)
        runs = sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(p, allow_not_found=True)) if f.type == pafs.FileType.Directory)
        if not runs:
            return spark.createDataFrame([], _full(self.schema))
        return spark.read.schema(_full(self.schema)).option("recursiveFileLookup", "true").parquet(*(f"{self.path}/{r}" for r in runs))

    def newest(self, spark: SparkSession, most_seconds: float | None = None) -> DataFrame:
        """The newest row of each key that is not older than ``most_seconds``."""
        rows = self.all(spark)
        if most_seconds is not None:
            rows = rows.where(F.col("made_at") >= time.time() - most_seconds)
        cols = [c for c in rows.columns if c != "key"]
        return rows.groupBy("key").agg(F.max_by(F.struct(*cols), "made_at").alias("r")).select("key", "r.*")

    def missing(self, wanted: DataFrame, usable: Column | None = None, most_seconds: float | None = None) -> DataFrame:
        """Rows of ``wanted`` (key, ...) whose key has no newest row that is ``usable``."""
        known = self.newest(wanted.sparkSession, most_seconds)
        known = known.where(usable) if usable is not None else known
        return wanted.join(known.select("key"), "key", "left_anti")

    def fill(self, todo: DataFrame, make: Make, every: int = EVERY, total: str | None = None, run: str | None = None) -> tuple[int, float]:
        """Make and commit a row for each of ``todo`` by ``make``, which gets a task's rows as they come and
        gives rows with their keys in any order. Returns how many were made, and the sum of their column
        ``total``. ``todo`` must be dealt to tasks by its content: read from files, or by a hash. A call with
        the name ``run`` of one that failed goes on behind that one's last commits."""
        path, run = self.path, run or uuid.uuid4().hex
        schema = to_arrow_schema(_full(self.schema))

        def task(batches):
            at = f"{path}/run={run}/part={TaskContext.get().partitionId()}"
            done, n, spent = _committed(at), 0, 0.0
            rows = (r for b in batches for r in b.to_pylist() if r["key"] not in done)
            held: list[dict] = []
            for got in make(rows):
                held.append({"made_at": time.time()} | got)
                n, spent = n + 1, spent + (got[total] or 0.0 if total else 0.0)
                if len(held) >= every:
                    _commit(at, held, schema)
                    held = []
            if held:
                _commit(at, held, schema)
            yield pa.RecordBatch.from_pydict({"n": [n], "spent": [spent]})

        got = todo.mapInArrow(task, "n long, spent double").agg(F.sum("n"), F.sum("spent")).collect()[0]
        return got[0] or 0, got[1] or 0.0

    def clear(self, spark: SparkSession) -> int:
        """Remove all; returns how many bytes there were."""
        fs, p = _fs(self.path)
        if fs.get_file_info(p).type == pafs.FileType.NotFound:
            return 0
        n = self.size()
        fs.delete_dir(p)
        return n

    def size(self) -> int:
        fs, p = _fs(self.path)
        found = fs.get_file_info(pafs.FileSelector(p, recursive=True, allow_not_found=True))
        return sum(f.size or 0 for f in found if f.type == pafs.FileType.File)


def _committed(at: str) -> set[str]:
    """Keys of the files a former attempt of this task left."""
    fs, p = _fs(at)
    found = fs.get_file_info(pafs.FileSelector(p, allow_not_found=True))
    keys: set[str] = set()
    for f in found:
        if f.path.endswith(".parquet"):
            with fs.open_input_file(f.path) as x:
                keys.update(pq.read_table(x, columns=["key"])["key"].to_pylist())
    return keys


def _commit(at: str, rows: list[dict], schema: pa.Schema) -> None:
    """A file of its own, under its final name only when it is whole; readers skip names with a dot before."""
    fs, p = _fs(at)
    fs.create_dir(p, recursive=True)
    name, out = uuid.uuid4().hex, io.BytesIO()
    pq.write_table(pa.Table.from_pylist(rows, schema), out)
    with fs.open_output_stream(f"{p}/.{name}.tmp", compression=None) as f:
        f.write(out.getbuffer())
    fs.move(f"{p}/.{name}.tmp", f"{p}/{name}.parquet")
