"""Incremental audits: snapshot files arrive in a folder and are judged as they do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types

from ..sources import crawl as C

SNAPSHOT = C.FETCHES + ", fetched_at timestamp"


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SNAPSHOT).parquet(path)


def fresh(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """Fetches whose body was not seen within ``late`` for the same URL and lens; the state of
    older ones is dropped behind the watermark."""
    keyed = rows.withColumn("body_sha", F.sha2(F.coalesce("body", F.lit("")), 256))
    return keyed.withWatermark("fetched_at", late).dropDuplicatesWithinWatermark(["site_id", "url", "lens", "body_sha"])


def block_rates(rows: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Share of blocked responses of each site and lens in windows of time."""
    judged = C.classify(rows).withWatermark("fetched_at", late)
    bad = F.coalesce(F.col("blocked_by").isin("waf", "challenge"), F.lit(False)) | F.coalesce(F.col("status") >= 400, F.lit(False))
    agg = judged.groupBy(F.window("fetched_at", window), "site_id", "lens").agg(F.count(F.lit(1)).alias("responses"), F.count_if(bad).alias("blocked"))
    return agg.select(F.col("window.start").alias("from"), "site_id", "lens", "responses", "blocked", F.round(F.col("blocked") / F.col("responses"), 4).alias("share"))


def audit_batches(rows: DataFrame, judge: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, by: str = "site_id"):
    """Keep every row under ``out``, and judge the sites of each micro-batch anew from all that is kept of them, so that
    a site has one verdict whatever batches its pages came in (``verdicts`` reads the last). A batch that is
    done again after a failure writes to the same places."""

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{out}/rows/epoch={epoch}")
        kept = spark.read.schema(types.StructType([*batch.schema, types.StructField("epoch", types.LongType())])).parquet(f"{out}/rows").where(F.col("epoch") <= epoch)
        touched = spark.read.schema(batch.schema).parquet(f"{out}/rows/epoch={epoch}").select(by).distinct()
        judge(kept.drop("epoch").join(touched, by, "left_semi")).write.mode("overwrite").parquet(f"{out}/verdicts/epoch={epoch}")

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def verdicts(spark: SparkSession, out: str, by: str = "site_id") -> DataFrame:
    """Of each site the rows of its last judgement by ``audit_batches``."""
    rows = spark.read.parquet(f"{out}/verdicts")
    last = rows.groupBy(by).agg(F.max("epoch").alias("epoch"))
    return rows.join(last, [by, "epoch"]).drop("epoch")
