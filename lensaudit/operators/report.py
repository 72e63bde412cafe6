"""Reports: one nested document for each site, as JSON, Markdown or terminal text."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types

from ..functions import text
from . import scoring

SCHEMA_VERSION = "1.0.0"
FAILURE = "array<struct<page: string, question: string, reference_answer: string, outcomes: array<string>, span_retrieved: boolean, likely_cause: string>>"
#: What a report says of an evaluation.
EVAL = (
    "struct<mean: double, ci95: array<double>, per_trial_stddev: double, per_trial: array<double>, question_trials: long, trials: long, questions_per_page: long, pages: long, abstention_rate: double, hallucination_rate: double, "
    "context_recall: double, retrieval_gap: double, coverage_loss: double, mode: string, chunk_count: long, top_k: int, embedding_model: string, answerer_model: string, judge_model: string, ground_truth: string, confidence: string, "
    f"input_tokens: long, output_tokens: long, cost_usd: double, cache_hits: long, failures: {FAILURE}, notes: array<string>>"
)
#: Failures that Markdown shows.
SHOWN = 25
ERROR = "struct<code: string, severity: string, message: string, url: string>"


def _errors(sites: DataFrame, warnings: DataFrame | None, most: int | None = None) -> DataFrame:
    """``sites`` with ``errors``, what went wrong in the crawl (a row each in ``warnings``: site_id, code,
    severity, message, url) by severity, code and URL; the first ``most``, or all."""
    none = F.expr(f"CAST(array() AS array<{ERROR}>)")
    if warnings is None:
        return sites.withColumn("errors", none)
    place = F.row_number().over(Window.partitionBy("site_id").orderBy("severity", "code", "url", "message"))
    rows = warnings.withColumn("_i", place)
    rows = rows if most is None else rows.where(F.col("_i") <= most)
    rows = rows.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("_i", F.struct("code", "severity", "message", "url").alias("e")))).alias("_e"))
    rows = rows.select("site_id", F.transform("_e", lambda x: x["e"]).alias("errors"))
    return sites.join(rows, "site_id", "left").withColumn("errors", F.coalesce("errors", none))


def documents(sites: DataFrame, results: DataFrame, warnings: DataFrame | None = None, measured: DataFrame | None = None) -> DataFrame:
    """site_id and ``report``, a JSON document that keeps nulls; ``measured``: site_id and ``eval``."""
    return _documents(sites, results, warnings, measured).select("site_id", F.to_json("doc", {"ignoreNullFields": "false"}).alias("report"))


def _evaluated(rows: DataFrame, measured: DataFrame | None) -> DataFrame:
    """``rows`` with ``eval``, null where nothing was measured."""
    return rows.withColumn("eval", F.lit(None).cast(EVAL)) if measured is None else rows.join(measured.select("site_id", "eval"), "site_id", "left")


def _documents(sites: DataFrame, results: DataFrame, warnings: DataFrame | None = None, measured: DataFrame | None = None) -> DataFrame:
    cats = scoring.category_scores(results)
    total = scoring.overall(cats)
    cats = cats.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("category", "points", "max"))).alias("categories"))
    checks = results.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("check_id", "category", "title", "status", "weight", "points", "confidence", "message", "evidence"))).alias("checks"))
    rows = _evaluated(_errors(sites, warnings), measured).join(total, "site_id", "left").join(cats, "site_id", "left").join(checks, "site_id", "left")
    doc = F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.struct(F.col("start_url").alias("url"), F.col("final_url")).alias("target"), F.struct(F.coalesce("overall", F.lit(0.0)).alias("overall"), F.lit(100.0).alias("max"), "categories").alias("score"), "checks", "eval", "errors")
    return rows.select("site_id", doc.alias("doc"))


def _answerability(e) -> Column:
    """The evaluation as a section of Markdown; null where there is none."""
    share = lambda c: F.concat(F.round(100 * e[c]).cast("int").cast("string"), F.lit("%"))
    line = lambda *parts: F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in parts))
    num = lambda c, digits=1: F.format_string(f"%.{digits}f", c)
    row = lambda f: line("| ", F.replace(f["page"], F.lit("|"), F.lit("%7C")), " | ", F.replace(f["question"], F.lit("|"), F.lit("\\|")), " | ", F.when(f["span_retrieved"], "yes").otherwise("no"), " | ", f["likely_cause"], " |")
    facts = F.concat_ws(
        "\n",
        line("- **Mean ", num(e["mean"]), "** (95% CI ", num(e["ci95"][0]), " to ", num(e["ci95"][1]), "; ", e["trials"].cast("string"), " trials, up to ", e["questions_per_page"].cast("string"), " questions a page)"),
        line("- Context recall ", share("context_recall"), ", retrieval gap ", share("retrieval_gap"), ", abstained ", share("abstention_rate"), ", hallucinated ", share("hallucination_rate")),
        line("- Retrieval: ", e["mode"], ", ", e["chunk_count"].cast("string"), " chunks, the best ", e["top_k"].cast("string"), " by `", e["embedding_model"], "`"),
        line("- Answers by `", e["answerer_model"], "`, verdicts by `", e["judge_model"], "`, $", num(e["cost_usd"], 4)),
        line("- Ground truth: **", e["ground_truth"], "**, confidence ", e["confidence"]),
        F.array_join(F.transform(e["notes"], lambda n: line("- ", n)), "\n"),
    )
    table = line("\n\n### Questions that failed in most trials\n\n| page | question | span retrieved | likely cause |\n|-|-|-|-|\n", F.array_join(F.transform(F.slice(e["failures"], 1, SHOWN), row), "\n"))
    return line("\n## Answerability\n\n", facts, F.when(F.size(e["failures"]) > 0, table).otherwise(""), "\n")


def markdown(sites: DataFrame, results: DataFrame, warnings: DataFrame | None = None, measured: DataFrame | None = None, limit: int = 12) -> DataFrame:
    """site_id and ``report``: the score, the first findings, the evaluation, statuses by category, and what
    went wrong."""
    cats = scoring.category_scores(results)
    total = scoring.overall(cats)
    found = scoring.top_findings(results, limit)
    line = F.concat(F.lit("- **"), "check_id", F.lit("** ("), "status", F.lit(") "), "message")
    found = found.groupBy("site_id").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"])).alias("findings"))
    row = F.concat_ws(" | ", "category", "n_pass", "n_warn", "n_fail", "n_skip", "n_error")
    counts = scoring.status_counts(results).groupBy("site_id").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(row)), lambda r: F.concat(F.lit("| "), r, F.lit(" |")))).alias("hygiene"))
    rows = _evaluated(_errors(sites, warnings, 25), measured).join(total, "site_id", "left").join(found, "site_id", "left").join(counts, "site_id", "left")
    lost = F.concat_ws("\n", F.transform("errors", lambda e: F.concat(F.lit("- "), e["code"], F.lit(" "), e["url"], F.lit(": "), e["message"])))
    body = F.concat(F.lit("# Audit of "), "start_url", F.lit("\n\nScore: "), F.coalesce("overall", F.lit(0.0)).cast("string"), F.lit(" / 100\n\n## Findings\n\n"), F.coalesce("findings", F.lit("None.")), F.lit("\n"), F.coalesce(_answerability(F.col("eval")), F.lit("")), F.lit("\n## Hygiene\n\n| category | pass | warn | fail | skip | error |\n|-|-|-|-|-|-|\n"), F.coalesce("hygiene", F.lit("")), F.lit("\n"), F.when(lost != "", F.concat(F.lit("\n## Errors\n\n"), lost, F.lit("\n"))).otherwise(""))
    return rows.select("site_id", body.alias("report"))


def terminal(sites: DataFrame, results: DataFrame, warnings: DataFrame | None = None, measured: DataFrame | None = None, limit: int = 8) -> DataFrame:
    """site_id and ``report``: the score, a bar for each scored category, the evaluation in a line, the first
    findings, and the first ten faults of the crawl."""
    total = scoring.overall(scoring.category_scores(results))
    cats = scoring.score_bars(scoring.category_scores(results))
    line = F.concat(F.rpad("category", 12, " "), F.lit(" "), "bar", F.lit(" "), F.format_string("%.1f / %.1f", "points", "max"))
    body = cats.groupBy("site_id").agg(F.concat_ws("\n", F.array_sort(F.collect_list(line))).alias("bars"))
    said = F.concat(F.rpad(F.upper("status"), 6, " "), "check_id", F.lit("  "), "message")
    found = scoring.top_findings(results, limit).groupBy("site_id").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("rank", said.alias("l")))), lambda x: x["l"])).alias("findings"))
    rows = _evaluated(_errors(sites, warnings, 10), measured).join(total, "site_id", "left").join(body, "site_id", "left").join(found, "site_id", "left")
    lost = F.nullif(F.concat_ws("\n", F.transform("errors", lambda e: F.concat(F.rpad(F.upper(e["severity"]), 8, " "), e["code"], F.lit("  "), e["url"], F.lit("  "), e["message"]))), F.lit(""))
    head = F.format_string("%s  %.1f / 100", "start_url", F.coalesce("overall", F.lit(0.0)))
    e = F.col("eval")
    said = F.when(e.isNotNull(), F.format_string("answerability %.1f (%.1f to %.1f), confidence %s", e["mean"], e["ci95"][0], e["ci95"][1], e["confidence"]))
    return rows.select("site_id", F.concat_ws("\n", head, "bars", said, "findings", lost).alias("report"))


FORMATS = {"json": documents, "markdown": markdown, "terminal": terminal}


def write(sites: DataFrame, results: DataFrame, formats: list[str], path: str, force: bool = False, warnings: DataFrame | None = None, measured: DataFrame | None = None) -> None:
    """Write each format's documents as text under ``path``; existing output only with ``force``."""
    for f in formats:
        rows = FORMATS[f](sites, results, warnings, measured)
        rows.select("report").write.mode("overwrite" if force else "errorifexists").text(os.path.join(path, f), lineSep="\n\n")


def json_schema(spark: SparkSession) -> str:
    """JSON Schema of the document that ``documents`` makes, from the very columns it is made of."""
    kinds = {"string": "string", "double": "number", "integer": "integer", "long": "integer", "boolean": "boolean"}

    def of(kind) -> dict:
        if isinstance(kind, types.StructType):
            return {"type": "object", "properties": {f.name: of(f.dataType) for f in kind}, "required": [f.name for f in kind]}
        if isinstance(kind, types.ArrayType):
            return {"type": ["array", "null"], "items": of(kind.elementType)}
        return {"type": [kinds[kind.typeName()], "null"]}

    sites = spark.createDataFrame([], "site_id string, start_url string, final_url string")
    results = spark.createDataFrame([], "site_id string, check_id string, category string, title string, weight int, status string, points double, confidence string, message string, evidence string")
    return json.dumps({"$schema": "https://json-schema.org/draft/2020-12/schema", "title": f"report {SCHEMA_VERSION}", **of(_documents(sites, results).schema["doc"].dataType)}, indent=2)


def bar(share):
    return text.bar(share)
