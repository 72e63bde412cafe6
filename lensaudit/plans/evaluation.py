"""The evaluation of an audited crawl: which pages, which questions, what was measured, and how far to trust it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import urls
from ..operators import calls, embedding, eval_run, questions, report
from ..sources import crawl as C

PAGE = ["site_id", "url"]


@dataclass(frozen=True)
class Plan:
    """Models, texts and limits of an evaluation. Without ``facts`` (id, question, answer, page, site) the answerer
    writes the questions. ``same_judge``: nobody chose the judge."""

    answerer: calls.Model
    judge: calls.Model
    work: str
    facts: DataFrame | None = None
    embedder: embedding.Embedder | None = None
    pages: int = 3
    questions: int = 50
    trials: int = 3
    k: int = fixed.TOP_K
    same_judge: bool = True


def first_pages(views: DataFrame, lens: str, most: int) -> DataFrame:
    """(site_id, url, text) of the first ``most`` pages with text of each site, as ``lens`` saw them."""
    place = F.row_number().over(Window.partitionBy("site_id").orderBy("pos", "url"))
    rows = views.where((F.col("lens") == lens) & (F.trim("text") != ""))
    return rows.select(*PAGE, "pos", "text").dropDuplicates(PAGE).withColumn("_i", place).where(F.col("_i") <= most).select(*PAGE, "text")


def _asked(plan: Plan, crawl: C.Crawl, pages: DataFrame, truth: DataFrame) -> DataFrame:
    if plan.facts is None:
        return questions.generate(truth, plan.answerer.ask, plan.work, plan.questions)
    sites = pages.join(crawl.sites.select("site_id", "start_url"), "site_id")
    rows = plan.facts.select("id", "question", F.col("answer").alias("reference_answer"), F.lit("").alias("source_span"), "page", F.col("site").alias("_site"))
    # a fact is of the site that it names, or of all; its page may be given without the site
    near = sites.select("site_id", "start_url").distinct().join(rows, F.coalesce(urls.bare(F.col("_site")) == urls.bare(F.col("start_url")), F.lit(True)))
    whole = F.when(F.coalesce(F.col("page"), F.lit("")) == "", None).when(F.col("page").startswith("http"), F.col("page")).otherwise(F.concat(F.regexp_replace("start_url", "/+$", ""), F.lit("/"), F.regexp_replace("page", "^/+", "")))
    near = questions.dedupe(near.withColumn("page", whole), ["site_id"], ["id", "question"])
    number = F.row_number().over(Window.partitionBy("site_id").orderBy("id", "question")).cast("long")
    near = near.withColumn("q_id", number).select("site_id", "q_id", "question", "reference_answer", "source_span", "page")
    own = pages.select(*PAGE).join(near.withColumnRenamed("site_id", "_s"), (F.col("site_id") == F.col("_s")) & (F.col("page") == F.col("url"))).drop("_s", "page")
    rest = pages.select(*PAGE).join(own.select(*PAGE).distinct(), PAGE, "left_anti")
    return own.unionByName(rest.join(near.drop("page"), "site_id"))


def run(plan: Plan, crawl: C.Crawl) -> tuple[eval_run.Evaluation, DataFrame]:
    """(the evaluation, a row for each site that was evaluated: site_id and ``eval``, as ``report.EVAL``).

    Answers come from what crawlers get; questions from facts, else from the rendered page where the crawl
    has one, else from the same text, which is circular: confidence is low then, and no gate may use it.
    Everything that is read twice is written under the plan's ``work``.
    """
    spark = crawl.sites.sparkSession

    def put(name: str, made: DataFrame) -> DataFrame:
        made.write.parquet(f"{plan.work}/{name}")
        return spark.read.schema(made.schema).parquet(f"{plan.work}/{name}")

    pages = put("pages", first_pages(crawl.views, "browser-nojs", plan.pages))
    rendered = crawl.views.where("lens = 'rendered' AND text <> ''").select(*PAGE, F.col("text").alias("_seen")).dropDuplicates(PAGE)
    truth = put("truth", pages.join(rendered, PAGE, "left").select(*PAGE, F.coalesce("_seen", "text").alias("text"), F.col("_seen").isNotNull().alias("rendered")))
    asked = put("questions", _asked(plan, crawl, pages, truth).select(*PAGE, "q_id", "question", "reference_answer", "source_span"))
    find: Callable | None = embedding.finder(plan.embedder, PAGE, plan.k) if plan.embedder else None
    done = eval_run.run(pages, asked, eval_run.live(plan.answerer), eval_run.live(plan.judge), f"{plan.work}/run", plan.trials, plan.k, find)
    rows = eval_run.results(done)

    basis = truth.join(asked.select(*PAGE).distinct(), PAGE, "left_semi").groupBy("site_id").agg(F.bool_or("rendered").alias("seen"))
    kind = F.lit("facts") if plan.facts is not None else F.when(F.col("seen"), "rendered").otherwise("crawler_only")
    by = F.lit(plan.embedder.name) if plan.embedder else F.lit("lexical")
    per_page = asked.groupBy(*PAGE).count().groupBy("site_id").agg(F.max("count").alias("most"))
    rows = rows.join(basis, "site_id").join(per_page, "site_id").join(done.usage, "site_id", "left").withColumn("truth", kind)
    trusted = questions.confidence(F.col("truth"))
    note = lambda when, said: F.when(when, F.lit(said))
    notes = F.array_compact(F.array(
        note(F.lit(plan.same_judge), f"The judge is the answerer ({plan.answerer.name}); a model of another family would not prefer its own answers."),
        note(F.col("mode") == "whole_page", "At least one page was too small for chunks and was given whole, so retrieval was not measured there."),
        F.when(F.coalesce("hits", F.lit(0)) > 0, F.concat(F.col("hits").cast("string"), F.lit(" calls were answered from the log: this is the earlier measurement, not a new one."))),
        note(trusted == "low", "Questions were written from the text that was searched: the result says how clear it is, not what was lost, and no gate may use it."),
    ))
    lost = F.transform(F.coalesce("failures", F.array()), lambda f: F.struct(f["url"].alias("page"), f["question"].alias("question"), f["reference_answer"].alias("reference_answer"), f["outcomes"].alias("outcomes"), f["span_hit"].alias("span_retrieved"), f["likely_cause"].alias("likely_cause")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    doc = {
        "mean": F.col("mean"), "ci95": F.array("ci_low", "ci_high"), "per_trial_stddev": F.col("per_trial_stddev"), "per_trial": F.col("per_trial"), "question_trials": F.col("question_trials"), "trials": F.lit(plan.trials), "questions_per_page": F.col("most"), "pages": F.col("pages"),
        "abstention_rate": F.col("abstention_rate"), "hallucination_rate": F.col("hallucination_rate"), "context_recall": F.col("context_recall"), "retrieval_gap": F.col("retrieval_gap"), "coverage_loss": F.col("coverage_loss"), "mode": F.col("mode"), "chunk_count": F.col("chunk_count"), "top_k": F.lit(plan.k),
        "embedding_model": by, "answerer_model": F.lit(plan.answerer.name), "judge_model": F.lit(plan.judge.name), "ground_truth": F.col("truth"), "confidence": trusted, "input_tokens": zero("input_tokens"), "output_tokens": zero("output_tokens"), "cost_usd": zero("cost_usd"), "cache_hits": zero("hits"), "failures": lost, "notes": notes,
    }
    whole = F.struct(*(v.alias(k) for k, v in doc.items())).cast(report.EVAL)
    return done, put("results", rows.select("site_id", whole.alias("eval")))
