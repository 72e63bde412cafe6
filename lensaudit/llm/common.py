"""Shared-folder storage, lineage cuts and skew-safe ranks used by several operators."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset on a local master (tests, a single machine) a temporary folder
    is made and set as the checkpoint folder of the session; a cluster must name one.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("lensaudit.shared.dir", None)
    if not conf:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="lensaudit-")
        spark.conf.set("lensaudit.shared.dir", conf)
        spark.sparkContext.setCheckpointDir(conf)
        _made.append(conf)
    return conf.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run of an operator. Removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


@atexit.register
def _clean() -> None:
    for path in _made:
        try:
            fs, p = pafs.FileSystem.from_uri(path)
            fs.delete_dir(p)
        except (OSError, pa.ArrowInvalid):
            continue  # the folder was never written, or the store is gone with the session


def stage(df: DataFrame, path: str, partition_by: Sequence[str] = (), files: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at the files. With
    ``files``, the last step writes at most so many."""
    w = (df.coalesce(files) if files else df).write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *paths: str) -> None:
    """Remove tables that are no longer read, and let Spark drop shuffles nobody refers to."""
    for path in paths:
        fs, p = pafs.FileSystem.from_uri(path)
        if fs.get_file_info(p).type != pafs.FileType.NotFound:
            fs.delete_dir(p)
    gc.collect()
    spark._jvm.System.gc()


def open_uri(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def put_file(uri: str, chunks: Iterator[bytes]) -> int:
    """Write a file under a temporary name and rename it, so that a retried or
    speculative task never leaves a half-written file under the final name."""
    fs, path = open_uri(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    tmp, n = f"{path}.{uuid.uuid4().hex}.tmp", 0
    with fs.open_output_stream(tmp, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
            n += len(chunk)
    fs.move(tmp, path)
    return n


def read_array(uri: str, dtype: str) -> np.ndarray:
    """Memory-map a flat file where the store is local, read it otherwise."""
    fs, path = open_uri(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r") if fs.get_file_info(path).size else np.empty(0, dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def batched(batches: Iterator[pa.RecordBatch], col: str, most: int) -> Iterator[pa.RecordBatch]:
    """Record batches cut to about ``most`` bytes of ``col``, or one row."""
    for b in batches:
        sizes = pc.binary_length(b.column(col)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto, a = np.cumsum(sizes), 0
        while a < b.num_rows:
            done = upto[a - 1] if a else 0
            z = max(a + 1, int(np.searchsorted(upto, done + most)))
            yield b.slice(a, z - a)
            a = z


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets(df: DataFrame, each: int) -> int:
    """A number of parts for ``df``: one for each ``each`` bytes of the files it reads, but no
    fewer than the shuffle partitions."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = sum(x for x in sizes if x < 1 << 60)  # what is no file has no known size
    return min(max(shuffle_partitions(df.sparkSession), size // each), 1 << 20)


def spread_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, few_keys: bool = False) -> DataFrame:
    """0-based rank of each row within ``keys``; no key is gathered in one task.

    Rows of a key are dealt to sub-groups by a hash of ``order``; each sub-group is
    numbered on its own and starts where the counts of those before it end. Rows that
    are equal in ``order`` share a sub-group, so ties get consecutive ranks. With
    ``few_keys`` the table of starts is at most keys x sub-groups rows and is broadcast.
    """
    salts = max(16, shuffle_partitions(df.sparkSession))
    sub = df.withColumn("_sub", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    by = [*keys, "_sub"]
    before = Window.partitionBy(*keys).orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = sub.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select(*by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    if few_keys:
        starts = F.broadcast(starts)
    ranked = sub.join(starts, by).withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long") - 1 + F.col("_start"))
    return ranked.drop("_sub", "_start")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def text_digest(col: str = "text"):
    """128 bits of SHA-256 of the UTF-8 text; null counts as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col(col), F.lit("")).cast("binary"), 256)), 1, 16)
