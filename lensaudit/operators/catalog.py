"""The catalogue of checks and how a check's rows become a result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed

COLUMNS = ("site_id", "check_id", "category", "title", "weight", "status", "points", "confidence", "message", "evidence")


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *c) for i, c in enumerate(fixed.CATALOG)], "ord int, check_id string, category string, title string, weight int")


def select(only: Sequence[str] = (), skip: Sequence[str] = ()) -> list[str]:
    """Check ids by id or category in any case; an ``only`` that names nothing is an error."""
    want, drop = ({x.strip().lower() for x in xs} for xs in (only, skip))
    named = [(i, {i.lower(), c.lower()}) for i, c, _, _ in fixed.CATALOG]
    if want and (bad := want - {x for _, names in named for x in names}):
        raise ValueError(f"unknown checks {', '.join(sorted(bad))}")
    return [i for i, names in named if (not want or names & want) and not names & drop]


def points(status: Column, weight: Column) -> Column:
    """All for a pass, half for a warning, none otherwise."""
    return F.when(status == "pass", weight.cast("double")).when(status == "warn", weight * 0.5).otherwise(0.0)


def decide(sites: DataFrame, agg: DataFrame, check_id: str, cases: Sequence[tuple], evidence: Sequence[str] = (), skip: str = "no pages were fetched successfully", skip_when: Column | None = None) -> DataFrame:
    """One row for each site by the first case that holds.

    ``agg`` has a row for each site with rows to judge; other sites are skipped. A case is
    (condition or None, status, message, confidence or nothing).
    """
    _, category, title, weight = next(c for c in fixed.CATALOG if c[0] == check_id)
    rows = sites.select("site_id").join(agg.withColumn("_any", F.lit(True)), "site_id", "left")
    none = F.col("_any").isNull() if skip_when is None else F.col("_any").isNull() | F.coalesce(skip_when, F.lit(False))
    status, message, sure = F.when(none, "skip"), F.when(none, skip), F.when(none, "high")
    for cond, s, text, *conf in cases:
        text = F.lit(text) if isinstance(text, str) else text
        cond = F.lit(True) if cond is None else F.coalesce(cond, F.lit(False))
        status, message, sure = status.when(cond, s), message.when(cond, text), sure.when(cond, conf[0] if conf else "high")
    facts = F.to_json(F.struct(*evidence), {"ignoreNullFields": "false"}) if evidence else F.lit("{}")
    rows = rows.select("site_id", status.alias("status"), message.alias("message"), sure.alias("confidence"), facts.alias("evidence"))
    w = F.lit(weight)
    return rows.select("site_id", F.lit(check_id).alias("check_id"), F.lit(category).alias("category"), F.lit(title).alias("title"), w.alias("weight"), "status", points(F.col("status"), w).alias("points"), "confidence", "message", "evidence")
