"""Model calls that are made once: a log by key, usage and cost, and spending in waves.

A call is known by its prompt, system text, model, endpoint, limit of tokens and trial. What the
log has is read, the rest is called on the executors and committed batch by batch (``sources.store``),
so neither a second reader nor a task that runs again calls a model for what was answered.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..sources.store import Store
from . import judging

KEPT = "run string, completion string, truncated boolean, error string, input_tokens long, output_tokens long, cost_usd double"
#: Calls of a wave where spending is limited; tasks that call side by side.
WAVE, PARTS = 64, 16


@dataclass(frozen=True)
class Request:
    """One call as a client gets it."""

    prompt: str
    system: str = ""
    max_tokens: int | None = None
    as_json: bool = False


@dataclass(frozen=True)
class Reply:
    """What a client gives back; ``truncated`` if the limit of tokens ended it."""

    text: str
    truncated: bool = False
    input_tokens: int = 0
    output_tokens: int = 0


Client = Callable[[Request], Reply]


def plain(client: Callable[[str], tuple[str, bool]]) -> Client:
    """A client of (text, truncated) from prompts alone; tokens are estimated by length."""

    def call(r: Request) -> Reply:
        text, cut = client(r.prompt)
        return Reply(text, cut, max(1, len(r.system + r.prompt) // 4), max(1, len(text) // 4))

    return call


@dataclass
class Ledger:
    """What a run may spend and has spent on calls, over all its models; None: no limit."""

    limit: float | None = None
    spent: float = field(default=0.0)

    def done(self) -> bool:
        return self.limit is not None and self.spent >= self.limit


@dataclass(frozen=True)
class Model:
    """A model with its log. ``rates``: dollars for a million tokens in and out; None counts as free.
    Failed calls are tried ``tries`` times, then logged as an error, which the next run tries again."""

    name: str
    client: Client
    log: str
    ledger: Ledger | None = None
    rates: tuple[float | None, float | None] = (None, None)
    base_url: str | None = None
    tries: int = fixed.MODEL_TRIES
    backoff: float = fixed.MODEL_BACKOFF
    every: int = 4

    def store(self) -> Store:
        return Store(self.log, KEPT)

    def ask(self, prompts: DataFrame, system: str = "", max_tokens: int | Column | None = None, as_json: bool = False, trial: Column | None = None) -> DataFrame:
        """``prompts`` (prompt, ...) with completion, truncated, error, input_tokens, output_tokens, cost_usd and
        ``hit`` (the log had it before this call). Rows of one prompt and ``trial`` are one call. ``prompts`` is
        read more than once: it should be a written table. Rows that the ledger left no money for
        have an error that says so."""
        spark, log = prompts.sparkSession, self.store()
        trial = F.lit("0") if trial is None else trial.cast("string")
        rows = prompts.withColumn("_limit", (max_tokens if isinstance(max_tokens, Column) else F.lit(max_tokens)).cast("int"))
        keyed = rows.withColumn("key", judging.call_key(F.col("prompt"), self.name, system, F.col("_limit"), self.base_url, trial))
        wanted = keyed.groupBy("key").agg(F.first("prompt").alias("prompt"), F.first("_limit").alias("limit"))
        todo = log.missing(wanted, F.col("error").isNull())
        spending = self.ledger is not None and self.ledger.limit is not None
        waves = max(1, -(-todo.count() // WAVE)) if spending else 1
        run = uuid.uuid4().hex
        call = self._caller(system, as_json, run)
        for wave in range(waves):
            if self.ledger and self.ledger.done():
                break
            mine = todo.where(F.pmod(F.xxhash64("key"), F.lit(waves)) == wave) if waves > 1 else todo
            _, spent = log.fill(mine.repartition(PARTS, "key"), call, self.every, "cost_usd")
            if self.ledger:
                self.ledger.spent += spent
        rows = keyed.join(log.newest(spark), "key", "left")
        lost = F.coalesce("error", F.when(F.col("made_at").isNull(), "not asked: the limit on cost was reached"))
        return rows.withColumns({"error": lost, "truncated": F.coalesce("truncated", F.lit(False)), "hit": F.coalesce(F.col("run") != run, F.lit(False))}).drop("key", "made_at", "run", "_limit")

    def _caller(self, system: str, as_json: bool, run: str) -> Callable[[Iterator[dict]], Iterator[dict]]:
        client, (rate_in, rate_out) = self.client, self.rates
        retry = judging.retrying(client, self.tries, self.backoff)

        def make(rows: Iterator[dict]) -> Iterator[dict]:
            for r in rows:
                try:
                    said = retry(Request(r["prompt"], system, r["limit"], as_json))
                    cost = round(said.input_tokens / 1e6 * (rate_in or 0.0) + said.output_tokens / 1e6 * (rate_out or 0.0), 6)
                    yield {"key": r["key"], "run": run, "completion": said.text, "truncated": said.truncated, "error": None, "input_tokens": said.input_tokens, "output_tokens": said.output_tokens, "cost_usd": cost}
                except Exception as e:  # noqa: BLE001 - whatever the client raises is a row
                    yield {"key": r["key"], "run": run, "completion": None, "truncated": False, "error": str(e) if isinstance(e, RuntimeError) else f"{type(e).__name__}: {e}", "input_tokens": 0, "output_tokens": 0, "cost_usd": 0.0}

        return make


def usage(*asked: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sums of what ``Model.ask`` returned, by the columns ``by``: calls and those the log had, failures, tokens
    and dollars of calls (those from the log were paid before, and count as hits alone)."""
    cols = [*(by or []), "hit", "error", "input_tokens", "output_tokens", "cost_usd"]
    rows = asked[0].select(cols)
    for more in asked[1:]:
        rows = rows.unionByName(more.select(cols))
    new = ~F.col("hit")
    paid = lambda c: F.coalesce(F.sum(F.when(new, F.col(c))), F.lit(0)).alias(c)
    return rows.groupBy(*(by or [])).agg(F.count_if(new & F.col("error").isNull()).alias("calls"), F.count_if("hit").alias("hits"), F.count_if(F.col("error").isNotNull()).alias("failed"), paid("input_tokens"), paid("output_tokens"), F.round(F.coalesce(F.sum(F.when(new, F.col("cost_usd"))), F.lit(0.0)), 6).alias("cost_usd"))
