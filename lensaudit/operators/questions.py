"""Questions: from facts, from generated JSON, filtered and without repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as T

_ITEMS = "struct<questions: array<struct<question: string, reference_answer: string, source_span: string, kind: string>>>"


#: Parts that a list of questions is dealt into where each of many pages takes all of it.
PARTS = 64


def dedupe(questions: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first of the questions that are the same by letters and digits; those without any go."""
    key = T.question_key(F.col("question"))
    rows = questions.withColumn("_key", key).where("_key <> ''")
    first = F.row_number().over(Window.partitionBy(*by, "_key").orderBy(*order))
    return rows.withColumn("_first", first).where("_first = 1").drop("_key", "_first")


def from_facts(facts: DataFrame, site_url: str | None = None) -> DataFrame:
    """Facts as questions without a span; relative pages become absolute."""
    page = F.col("page")
    if site_url:
        full = F.concat(F.lit(site_url.rstrip("/") + "/"), F.regexp_replace("page", "^/+", ""))
        page = F.when(page.startswith("http") | (F.coalesce(page, F.lit("")) == ""), page).otherwise(full)
    rows = facts.select(F.col("id"), "question", F.col("answer").alias("reference_answer"), F.lit("").alias("source_span"), F.lit("facts").alias("kind"), page.alias("page"))
    return dedupe(rows, ["kind"], ["id"])


def parse_generated(raw: Column) -> Column:
    """Array of questions from JSON, or from the braces in prose around it; null if neither parses."""
    inner = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    ok = lambda x: F.when(F.try_parse_json(x).isNotNull(), F.from_json(x, _ITEMS)["questions"])
    return F.coalesce(ok(raw), ok(inner))


GENERATE_SYSTEM = """You are given the text of a web page. Write questions about it that a visitor, or someone who uses an assistant, might ask.
- The text alone must answer each question; nothing that needs other knowledge, and nothing that the text does not say.
- Ask for different things: facts such as prices, dates and names; what something is; how something is done; how things compare.
- reference_answer is the answer, as the text gives it. source_span is the passage of the text with the answer, copied character by character.
Reply with one JSON object and nothing else: {"questions": [{"question": "...", "reference_answer": "...", "source_span": "...", "kind": "..."}]}"""
GENERATE_PROMPT = "Page: {url}\n\nText of the page:\n<<<\n{text}\n>>>\n\nWrite up to {count} questions about it, as JSON."


def generate(pages: DataFrame, ask, work: str, count: int = 50) -> DataFrame:
    """Questions (site_id, url, q_id, question, reference_answer, source_span, kind) that a model writes about
    ``pages`` (site_id, url, text), at most ``count`` a page: ``ask`` as ``calls.Model.ask``. What a model gets of
    a page is at most GEN_INPUT_MOST characters, as it can read no more. Failed and cut-off replies give no
    questions, nor do empty texts. Written under ``work``."""
    page, spark = ["site_id", "url"], pages.sparkSession
    rows = pages.where(F.trim("text") != "").select(*page, "text", F.substring("text", 1, fixed.GEN_INPUT_MOST).alias("_part"))
    parts = GENERATE_PROMPT.replace("{count}", str(count))
    head, _, rest = parts.partition("{url}")
    middle, _, tail = rest.partition("{text}")
    rows = rows.select(*page, "text", F.concat(F.lit(head), "url", F.lit(middle), "_part", F.lit(tail)).alias("prompt"), token_budget(F.lit(count), F.length("_part")).alias("budget"))
    rows.write.parquet(f"{work}/generate")
    said = ask(spark.read.schema(rows.schema).parquet(f"{work}/generate"), GENERATE_SYSTEM, F.col("budget"), True)
    said = said.where(F.col("error").isNull() & ~F.col("truncated")).select(*page, F.col("text").alias("ground_truth"), F.posexplode(parse_generated(F.col("completion"))).alias("pos", "q"))
    kept = post_filter(said.select(*page, "ground_truth", "pos", "q.*"), page, ["pos"]).where(F.col("pos") < count)
    made = kept.select(*page, F.col("pos").cast("long").alias("q_id"), "question", "reference_answer", "source_span", F.coalesce("kind", F.lit("")).alias("kind"))
    made.write.parquet(f"{work}/generated")
    return spark.read.schema(made.schema).parquet(f"{work}/generated")


def token_budget(count: Column, chars: Column) -> Column:
    """Output tokens allowed to generate ``count`` questions from so much text."""
    thought = F.floor(chars / 4 * fixed.GEN_REASONING)
    return F.least(F.lit(fixed.GEN_BUDGET) + count * fixed.GEN_PER_QUESTION + thought, F.lit(fixed.GEN_MOST)).cast("int")


def post_filter(items: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Drops short questions and answers, blanks spans that ``ground_truth`` does not hold, dedupes."""
    strip = lambda c: T.strip(F.coalesce(F.col(c), F.lit("")))
    rows = items.withColumns({c: strip(c) for c in ("question", "reference_answer", "source_span")})
    rows = rows.where((F.length("question") >= fixed.MIN_QUESTION) & (F.length("reference_answer") >= fixed.MIN_ANSWER))
    flat = lambda c: F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), rf"{T.SPACE}+", " ")
    there = F.contains(flat("ground_truth"), F.substring(flat("source_span"), 1, fixed.SPAN_KEY))
    rows = rows.withColumn("source_span", F.when(there, F.col("source_span")).otherwise(""))
    return dedupe(rows, by, order)


def confidence(ground_truth: Column) -> Column:
    return F.when(ground_truth.isin("facts", "facts+rendered", "rendered"), "high").otherwise("low")


def for_page(questions: DataFrame, pages: DataFrame) -> DataFrame:
    """Questions of each page of ``pages`` (url): those that name it, or all where none does: by meaning as many
    rows as such pages times questions."""
    urls = pages.select("url")
    named = questions.select(F.col("page").alias("url")).distinct()
    own = urls.join(questions, F.col("url") == F.col("page"))
    # pages without questions of their own meet the list through a key, by its parts: no cross join
    rest = urls.join(named, "url", "left_anti").withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    dealt = questions.withColumn("_part", F.pmod(F.xxhash64(*questions.columns), F.lit(PARTS)).cast("int"))
    return own.unionByName(rest.join(dealt, "_part").drop("_part"))
