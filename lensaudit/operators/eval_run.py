"""The answerability evaluation from pages to metrics.

Chunks of each page, the best of them for each question, a prompt from those alone, an answer
and a verdict for each question and trial, and the sums. Each step is a table that is written
before the next one reads it, so nothing is made twice, and no model is called twice. A model is a
``calls.Model``, which keeps a log, or completions that are there already (``recorded``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from . import calls, chunking, evals, judging, retrieval

PAGE = ["site_id", "url"]
ASKED = [*PAGE, "q_id"]
CELL = [*ASKED, "trial"]

#: (prompts, system text, limit of tokens, whether the reply is JSON) to prompts with completion, truncated, error.
Asker = Callable[[DataFrame, str, int, bool], DataFrame]


@dataclass(frozen=True)
class Evaluation:
    """Written tables of a run: ``chunks`` of the pages with their mode; ``asked``, a row for each question
    with its prompt; ``answers`` and ``outcomes``, a row for each question and trial. Outcomes have answer,
    abstained, quoted, verdict, has_span, span_hit and error, and no text of pages or questions.
    ``usage``: calls, hits, failed, input_tokens, output_tokens and cost_usd of each site; empty for
    recorded models."""

    chunks: DataFrame
    asked: DataFrame
    answers: DataFrame
    outcomes: DataFrame
    usage: DataFrame


def recorded(log: DataFrame, by: list[str] = CELL) -> Asker:
    """A model that reads ``log`` (``by``, completion, truncated, error); what is not in it is an error."""

    def run(prompts: DataFrame, *_) -> DataFrame:
        rows = prompts.join(log.select(*by, "completion", "truncated", F.col("error").alias("_error"), F.lit(True).alias("_there")), by, "left")
        return rows.withColumns({"truncated": F.coalesce("truncated", F.lit(False)), "error": F.when(F.col("_there"), F.col("_error")).otherwise("not recorded")}).drop("_error", "_there")

    return run


def live(model: calls.Model) -> Asker:
    """A model that is called on the executors, once for each prompt and trial."""
    return lambda prompts, system, limit, as_json: model.ask(prompts, system, limit, as_json, F.col("trial"))


_USAGE = ("hit boolean", "input_tokens long", "output_tokens long", "cost_usd double")


def _metered(rows: DataFrame) -> DataFrame:
    """``rows`` with the columns of a call's usage, null where a recorded model has none."""
    return rows.withColumns({c.split(" ")[0]: F.lit(None).cast(c.split(" ")[1]) for c in _USAGE if c.split(" ")[0] not in rows.columns})


def run(pages: DataFrame, questions: DataFrame, answerer: Asker, judge: Asker, work: str, trials: int = 3, k: int = fixed.TOP_K, find: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> Evaluation:
    """Evaluate ``questions`` (site_id, url, q_id, question, reference_answer, source_span) on ``pages`` (site_id,
    url, text) under ``work``, a new folder that driver and executors share.

    An answerer that fails or is cut off abstains with an error; a judge that does abstains
    without one. NOT_FOUND is not sent to the judge. Questions of pages without text have a
    prompt that says so. ``find`` (questions, chunks) takes the place of retrieval by words.
    """
    spark = pages.sparkSession

    def put(name: str, made: DataFrame) -> DataFrame:
        made.write.parquet(f"{work}/{name}")
        return spark.read.schema(made.schema).parquet(f"{work}/{name}")

    chunks = put("chunks", chunking.prepare(pages, PAGE))
    found = find(questions, chunks) if find else retrieval.lexical_top_k(questions, chunks, PAGE, k)
    found = put("found", found.select(*ASKED, "chunk_idx", "rank", "score").join(chunks.select(*PAGE, "chunk_idx", "text"), [*PAGE, "chunk_idx"]))
    span = F.coalesce("source_span", F.lit(""))
    hits = questions.select(*ASKED, span.alias("_span")).join(found, ASKED, "left")
    hits = hits.groupBy(*ASKED).agg(F.bool_or(F.col("_span") != "").alias("has_span"), F.coalesce(F.bool_or(judging.text.span_in(F.col("_span"), F.col("text"))), F.lit(False)).alias("span_hit"))
    asked = put("asked", judging.answer_prompt(found, questions.select(*ASKED, "question", "reference_answer"), ASKED).join(hits, ASKED))

    cells = asked.select(*ASKED, "prompt", F.explode(F.sequence(F.lit(0), F.lit(max(1, trials) - 1))).alias("trial"))
    said = _metered(answerer(cells, judging.ANSWER_SYSTEM, fixed.ANSWER_TOKENS, False))
    cut = F.lit(f"the answer hit the limit of {fixed.ANSWER_TOKENS} tokens")
    error = F.coalesce("error", F.when(F.col("truncated"), cut))
    parsed, failed = judging.parse_answer(F.col("completion")), error.isNotNull()
    usage = ("hit", "input_tokens", "output_tokens", "cost_usd")
    answers = put("answers", said.select(*CELL, F.when(failed, "NOT_FOUND").otherwise(parsed["answer"]).alias("answer"), (failed | parsed["abstained"]).alias("abstained"), F.when(failed, "").otherwise(parsed["quoted"]).alias("quoted"), error.alias("error"), *usage))

    none = F.upper(F.trim("answer")) == "NOT_FOUND"
    graded = answers.where(~none).select(*CELL, "answer").join(asked.select(*ASKED, "question", "reference_answer"), ASKED)
    graded = put("graded_prompts", graded.select(*CELL, judging.judge_prompt(F.col("question"), F.col("reference_answer"), F.col("answer")).alias("prompt")))
    graded = _metered(judge(graded, judging.JUDGE_SYSTEM, fixed.ANSWER_TOKENS, True))
    graded = put("verdicts", graded.select(*CELL, "completion", (F.col("error").isNotNull() | F.col("truncated")).alias("_lost"), F.col("error").alias("judge_error"), *usage))
    rows = answers.drop(*usage).join(graded.select(*CELL, "completion", "_lost"), CELL, "left").join(asked.select(*ASKED, "has_span", "span_hit"), ASKED)
    verdict = judging.settle(F.col("answer"), F.col("completion"), F.col("abstained"), F.coalesce("_lost", F.lit(True)))
    outcomes = put("outcomes", rows.select(*CELL, "answer", "abstained", "quoted", verdict.alias("verdict"), "has_span", "span_hit", "error"))
    metered = calls.usage(answers.where("hit IS NOT NULL"), graded.where("hit IS NOT NULL").withColumnRenamed("judge_error", "error"), by=["site_id"])
    return Evaluation(chunks, asked, answers, outcomes, metered)


def results(done: Evaluation) -> DataFrame:
    """Metrics of each site (``evals.site_results``) with per_trial (scores in the order of url and
    trial), chunk_count and mode (whole_page if any page is) of the evaluated pages, and the
    failures, the first hundred by url and question."""
    by_trial = evals.by_trial(done.outcomes)
    per_trial = by_trial.groupBy("site_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("url", "trial", "score"))), lambda x: x["score"]).alias("per_trial"))
    used = done.chunks.select(*PAGE, "mode").join(done.asked.select(*PAGE).distinct(), PAGE)
    shape = used.groupBy("site_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.when(F.bool_or(F.col("mode") == "whole_page"), "whole_page").otherwise("chunked").alias("mode"))
    return evals.site_results(done.outcomes).join(per_trial, "site_id").join(shape, "site_id", "left").join(failures(done), "site_id", "left").withColumn("n_failures", F.coalesce(F.size("failures"), F.lit(0)))


def failures(done: Evaluation, most: int = fixed.FAILURES_KEPT) -> DataFrame:
    """site_id and ``failures``: page, question, reference answer, outcomes, span_hit and likely
    cause of the first ``most`` (what a report shows; ``evals.failures`` has all)."""
    rows = evals.failures(done.outcomes)
    place = F.row_number().over(Window.partitionBy("site_id").orderBy("url", "q_id"))
    rows = rows.withColumn("_i", place).where(F.col("_i") <= most).join(done.asked.select(*ASKED, "question", "reference_answer"), ASKED)
    return rows.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("_i", "url", "question", "reference_answer", "outcomes", "span_hit", "likely_cause"))).alias("failures"))
