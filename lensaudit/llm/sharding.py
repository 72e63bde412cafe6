"""Sharding: indivisible groups of equal texts into a fixed number of even shards.

Best-fit-decreasing over the sizes of the groups (``fit.even``). The driver sees only
a histogram of group sizes; groups and rows stay distributed, and copies of one text
are counted before they are shuffled.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, fit

#: A table of placements up to this many rows (about 32 bytes each) is broadcast.
BROADCAST_ROWS = 200_000


def assign_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Put every row of ``docs`` (doc_id, text) into shards 0 to ``shards`` - 1.

    Law ``bytes``: size is the UTF-8 length plus 1, a group of equal texts is never
    divided, and shards are of near equal size. Returns doc_id, size, text_crc32, law,
    shard, slot (gapless from 0 in each shard) and grown_shard (null under this law).

    Null text counts as empty and shares the group of empty texts (size 1, crc 0).
    Null or repeated doc_ids are rows like others; equal rows take neighbouring slots.
    A group over the even share has a shard to itself; shards may stay empty when
    groups are few. Texts of any length count whole. An empty table gives an empty result.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    work = common.work_dir(spark, "shards")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    base = common.stage(docs.select(F.col("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), common.text_digest().alias("group")), f"{work}/rows")

    groups = base.groupBy("group", "size").agg(F.count(F.lit(1)).alias("n")).select("group", (F.col("n") * F.col("size")).alias("bytes"))
    hist = [(r["bytes"], r["n"]) for r in groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()]
    placed = fit.even(hist, shards)
    table = spark.createDataFrame(pa.table({"bytes": pa.array([p.size for p in placed], pa.int64()), "lo": pa.array([p.lo for p in placed], pa.int64()), "hi": pa.array([p.hi for p in placed], pa.int64()), "shard": pa.array([p.bin for p in placed], pa.int32())}))
    table = F.broadcast(table) if len(placed) <= BROADCAST_ROWS else table
    ranked = common.spread_rank(groups, ["bytes"], ["group"], "rank")
    where = ranked.join(table, "bytes").where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select("group", "shard")

    rows = base.join(where, "group").select("doc_id", "size", "text_crc32", "shard")
    rows = common.spread_rank(rows, ["shard"], ["doc_id", "text_crc32", "size"], "slot", few_keys=True)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
