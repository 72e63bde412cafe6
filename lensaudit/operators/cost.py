"""Token and cost estimates, prices by model prefix, and budget guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as T


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *p) for i, p in enumerate(fixed.PRICES)], "ord int, prefix string, input_rate double, output_rate double")


def short_name(model: Column) -> Column:
    return F.lower(F.element_at(F.split(model, "/"), -1))


def price_lookup(models: DataFrame) -> DataFrame:
    """Rates of each ``model`` by the first prefix of the (21-row) table that fits; null if none."""
    table = F.broadcast(prices(models.sparkSession))
    hit = models.select("model").distinct().join(table, short_name(F.col("model")).startswith(F.col("prefix")))
    best = hit.groupBy("model").agg(F.min_by(F.struct("prefix", "input_rate", "output_rate"), "ord").alias("p"))
    return models.join(best, "model", "left").select(*models.columns, "p.prefix", "p.input_rate", "p.output_rate")


def rates(model: str) -> tuple[float | None, float | None]:
    """Rates of one model, by the same table."""
    name = model.rpartition("/")[2].lower()
    return next(((i, o) for prefix, i, o in fixed.PRICES if name.startswith(prefix)), (None, None))


def unpriced(models: DataFrame) -> DataFrame:
    return price_lookup(models.select("model").distinct()).where("input_rate is null").select("model")


class UnknownPrice(ValueError):
    """A limit on cost that cannot be kept."""


class OverBudget(ValueError):
    """An estimate above the limit."""


def enforce(models: DataFrame, estimates: DataFrame, most: float | None, rates: tuple[float | None, float | None] = (None, None)) -> None:
    """Before any call: with a limit, every one of the (few) ``models`` has a price, or both ``rates``
    are given, and no estimate is above the limit."""
    if most is None:
        return
    if None in rates and (names := [r["model"] for r in unpriced(models).orderBy("model").collect()]):
        raise UnknownPrice(f"a limit of ${most:.2f} is set, but no price is known for {', '.join(names)}; give prices for a million tokens, or no limit")
    worst = estimates.agg(F.max("cost_usd")).collect()[0][0]
    if worst is not None and worst > most:
        raise OverBudget(f"the estimated cost of ${worst:.4f} is above the limit of ${most:.2f}; ask fewer questions, trials or pages")


def is_embedding_model(model: Column) -> Column:
    s = short_name(model)
    out = F.contains(s, F.lit("-embed"))
    for p in fixed.EMBEDDING_PREFIXES:
        out = out | s.startswith(p)
    return out


def cost(tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column) -> Column:
    """Rounded USD; 0 where the price is not known."""
    return F.coalesce(F.round(tokens_in / 1e6 * rate_in + tokens_out / 1e6 * rate_out, 6), F.lit(0.0))


def estimate(pages: DataFrame, by: list[str], questions: int, trials: int, answer: tuple[float | None, float | None], judge: tuple[float | None, float | None] | None = None, whole_page: bool = False) -> DataFrame:
    """Calls, tokens and cost of an evaluation of ``pages`` (by columns, text, chunks), by group.

    Context of an answer is all chunks at 400 tokens, never more than the page; embedding
    tokens are counted but not priced.
    """
    qt = questions * trials
    page = T.approx_tokens(F.col("text"))
    ctx = page if whole_page else F.least(F.col("chunks") * fixed.CHUNK_TOKENS, page)
    rate = lambda p: tuple(F.lit(x).cast("double") for x in p)
    a, j = rate(answer), rate(judge or answer)
    rows = pages.select(*by, "chunks", (F.least(page, F.lit(fixed.GEN_INPUT_MOST)) + fixed.GEN_SYSTEM).alias("gen"), (qt * (ctx + fixed.ANSWER_OVERHEAD)).alias("ans"))
    money = cost(F.col("ans"), F.lit(qt * 120), *a) + cost(F.lit(qt * 200), F.lit(qt * 40), *j)
    gen_in = F.col("gen") if questions else F.lit(0)
    money = money + (cost(gen_in, F.lit(questions * 120), *a) if questions else 0.0)
    n = F.count(F.lit(1))
    return rows.groupBy(*by).agg(n.alias("pages"), (n * qt).alias("answer_calls"), (n * qt).alias("judge_calls"), n.alias("embed_calls"), (n * int(questions > 0)).alias("generation_calls"), F.sum(gen_in + F.col("ans") + qt * 200).alias("input_tokens"), (n * (questions * 120 + qt * 160)).alias("output_tokens"), F.sum(F.col("chunks") * 200).alias("embed_tokens"), F.round(F.sum(money), 6).alias("cost_usd"))


def exceeds(estimates: DataFrame, most: float | None) -> DataFrame:
    return estimates.withColumn("exceeds", F.lit(False) if most is None else F.col("cost_usd") > most)
