"""Scores, status counts and findings from check results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text


def category_scores(results: DataFrame) -> DataFrame:
    """Points and maximum of each scored category of a site; skipped checks do not count."""
    counted = F.col("status") != "skip"
    rows = results.where(F.col("category").isin(*fixed.SCORED_CATEGORIES))
    return rows.groupBy("site_id", "category").agg(F.round(F.coalesce(F.sum(F.when(counted, F.col("points"))), F.lit(0.0)), 2).alias("points"), F.round(F.coalesce(F.sum(F.when(counted, F.col("weight"))), F.lit(0)).cast("double"), 2).alias("max"))


def overall(categories: DataFrame) -> DataFrame:
    """Score of 0 to 100 over all scored categories; 0 where nothing counts."""
    ratio = F.try_divide(100.0 * F.sum("points"), F.sum("max"))
    return categories.groupBy("site_id").agg(F.coalesce(F.round(ratio, 1), F.lit(0.0)).alias("overall"))


def status_counts(results: DataFrame) -> DataFrame:
    """Checks of each status in each category of unscored checks."""
    return results.where("weight = 0").groupBy("site_id", "category").agg(*(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in fixed.STATUSES))


def top_findings(results: DataFrame, limit: int = 10) -> DataFrame:
    """The first ``limit`` faults of each site: failures, errors, warnings, heavier checks first,
    then in catalogue order."""
    order = F.create_map(*(F.lit(x) for i, c in enumerate(fixed.CATALOG) for x in (c[0], i)))
    rank = F.when(F.col("status") == "fail", 0).when(F.col("status") == "error", 1).when(F.col("status") == "warn", 2)
    rows = results.withColumn("_p", rank).where("_p is not null").withColumn("_o", order[F.col("check_id")])
    pos = F.row_number().over(Window.partitionBy("site_id").orderBy("_p", F.desc("weight"), "_o"))
    return rows.withColumn("rank", pos).where(F.col("rank") <= limit).drop("_p", "_o")


def score_bars(categories: DataFrame) -> DataFrame:
    return categories.withColumn("bar", text.bar(F.coalesce(F.try_divide("points", "max"), F.lit(0.0))))


def calibration(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Recorded against actual statuses of each check: compared, different, false alarms on
    known-good sites, and expectations without a result."""
    both = expected.join(results.select("site_id", "check_id", F.col("status").alias("actual")), ["site_id", "check_id"], "full_outer").where("status is not null")
    wrong = ~F.col("status").eqNullSafe(F.col("actual"))
    return both.groupBy("check_id").agg(F.count(F.lit(1)).alias("compared"), F.count_if(wrong).alias("different"), F.count_if(F.col("known_good") & wrong & F.col("actual").isin("fail", "warn")).alias("false_alarms"), F.count_if(F.col("actual").isNull()).alias("absent"))


def score_for(results: DataFrame, check_id: str) -> DataFrame:
    """site_id and points of one check."""
    return results.where(F.col("check_id") == check_id).select("site_id", "points")
