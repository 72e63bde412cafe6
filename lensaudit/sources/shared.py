"""The folder that driver and executors share, and slices of Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Rows of a slice of a batch, and bytes of the texts read in it.
SLICE_ROWS, SLICE_BYTES = 256, 1 << 21


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``. Where that is unset, a local master takes a temporary
    one; a cluster must name it."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not conf and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = conf.rstrip("/") if conf else "file://" + tempfile.mkdtemp(prefix="lensaudit-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def slices(batches, column: str) -> Iterator[pa.RecordBatch]:
    """All rows of ``batches`` in slices of SLICE_ROWS, and of SLICE_BYTES of ``column`` but for slices of one
    row: what a task makes of rows in Python lives for a slice, however many rows come at once."""
    for b in batches:
        start = held = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist()):
            if i > start and (i - start == SLICE_ROWS or held + n > SLICE_BYTES):
                yield b.slice(start, i - start)
                start, held = i, 0
            held += n
        yield b.slice(start)
