"""Evaluation: trials to pages to sites, failures and their causes, and gates.

``trials``: site_id, url, q_id, trial, verdict, span_hit, has_span, error; one row for each
question and trial.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import numbers


def points(verdict: Column) -> Column:
    return F.when(verdict == "correct", 1.0).when(verdict == "partially_correct", 0.5).otherwise(0.0)


def by_trial(trials: DataFrame) -> DataFrame:
    """Sums of each page and trial. Rows with an error count neither as abstained nor as wrong."""
    fair = F.col("error").isNull()
    hit = F.col("has_span") & F.col("span_hit")
    return trials.groupBy("site_id", "url", "trial").agg(F.count(F.lit(1)).alias("n"), F.sum(points(F.col("verdict"))).alias("points"), F.count_if(fair & (F.col("verdict") == "abstained")).alias("abstained"), F.count_if(fair & (F.col("verdict") == "incorrect")).alias("wrong"), F.count_if(hit).alias("hits"), F.count_if("has_span").alias("spans"), F.countDistinct("q_id").alias("questions")).withColumn("score", F.round(100.0 * F.col("points") / F.col("n"), 4))


def _pooled(rows: DataFrame, by: list[str], no_spans: Column) -> DataFrame:
    agg = rows.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("n", "points", "abstained", "wrong", "hits", "spans")), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("sd"), F.max("questions").alias("questions"), F.countDistinct("url").alias("pages"), F.countDistinct("trial").alias("trials"))
    rate = F.col("points") / F.col("n")
    lo, hi = numbers.ci95(rate, F.col("n"))
    recall = F.coalesce(F.try_divide("hits", "spans"), no_spans)
    return agg.select(*by, F.round(100 * rate, 4).alias("mean"), F.round("sd", 4).alias("per_trial_stddev"), F.round(100 * lo, 2).alias("ci_low"), F.round(100 * hi, 2).alias("ci_high"), F.col("n").alias("question_trials"), numbers.share(F.col("abstained"), F.col("n")).alias("abstention_rate"), numbers.share(F.col("wrong"), F.col("n")).alias("hallucination_rate"), F.round(recall, 4).alias("context_recall"), F.round(recall - rate, 4).alias("retrieval_gap"), "questions", "pages", "trials")


def page_results(trials: DataFrame) -> DataFrame:
    """Metrics of each page; context_recall is null where no question has a span."""
    return _pooled(by_trial(trials), ["site_id", "url"], F.lit(None).cast("double")).drop("pages", "retrieval_gap")


def site_results(trials: DataFrame) -> DataFrame:
    """Metrics of each site, pooled over question-trials; context_recall is 0 without spans, and
    coverage_loss the mean of its pages'."""
    loss = coverage_loss(trials).groupBy("site_id").agg(F.round(F.avg("coverage_loss"), 4).alias("coverage_loss"))
    return _pooled(by_trial(trials), ["site_id"], F.lit(0.0)).join(loss, "site_id")


def _by_question(trials: DataFrame) -> DataFrame:
    return trials.groupBy("site_id", "url", "q_id").agg(F.count(F.lit(1)).alias("trials"), F.count_if(F.col("verdict") == "correct").alias("correct"), F.count_if(F.col("verdict") == "incorrect").alias("incorrect"), F.countDistinct("verdict").alias("kinds"), F.min_by("span_hit", "trial").alias("span_hit"), F.array_sort(F.collect_list(F.struct("trial", "verdict"))).alias("outcomes"))


def coverage_loss(trials: DataFrame) -> DataFrame:
    """Share of a page's questions that no trial answered correctly."""
    return _by_question(trials).groupBy("site_id", "url").agg(F.round(F.avg((F.col("correct") == 0).cast("double")), 4).alias("coverage_loss"))


def failures(trials: DataFrame) -> DataFrame:
    """Questions not answered correctly in most trials, with the likely cause."""
    rows = _by_question(trials).where(F.col("correct") < F.greatest(F.lit(1), F.expr("trials div 2 + 1")))
    cause = F.when(~F.col("span_hit"), "content_not_in_crawler_view").when((F.col("incorrect") > 0) | (F.col("kinds") > 1), "answerer_error").otherwise("content_ambiguous")
    return rows.select("site_id", "url", "q_id", F.transform("outcomes", lambda o: o["verdict"]).alias("outcomes"), "span_hit", cause.alias("likely_cause"))


def gate(results: DataFrame, fail_under: float | None, margin: float = fixed.GATE_MARGIN, strict: bool = False) -> DataFrame:
    """Whether a mean below ``fail_under`` fails, and why it does not: low confidence or a wide
    interval, unless strict. ``results``: mean, ci_low, ci_high, confidence."""
    if fail_under is None:
        return results.withColumns({"fails": F.lit(False), "note": F.lit("")})
    half = (F.col("ci_high") - F.col("ci_low")) / 2
    low, wide = F.col("confidence") == "low", half > margin
    below = F.col("mean") < fail_under
    note = F.when(low, "circular ground truth").when(wide, F.concat(F.lit("95% CI is ±"), F.round(half).cast("int"), F.lit(" points"))).otherwise("")
    return results.withColumns({"fails": F.when(low | wide, below & F.lit(strict)).otherwise(below), "note": note})


def score_gate(scores: DataFrame, fail_under: float) -> DataFrame:
    return scores.withColumn("fails", F.col("overall") < fail_under)
