"""Prompts and parsing around the language model, whose calls are injected or recorded."""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text

#: What the models are told; their replies are read by ``parse_answer`` and ``parse_verdict``.
ANSWER_SYSTEM = """Below are excerpts of a website and a question about it. The excerpts are all you may use.
- If they answer the question, reply with one sentence, as far as possible in their words. Then begin a new line with "Used: " and copy there the sentence you relied on.
- If they do not, your whole reply is NOT_FOUND. What you know from elsewhere does not count, and a likely number, date or name is not an answer.
A program reads the reply: add nothing else."""
JUDGE_SYSTEM = """Compare the candidate's answer to a question with the reference answer. Only the reference counts, not what you know yourself.
Reply with one JSON object and nothing else: {"verdict": "...", "rationale": "one short sentence"}
The verdict is one of these words:
correct - the candidate states the facts of the reference, in whatever words;
partially_correct - it states some of them, but lacks or misstates one that matters;
incorrect - it contradicts the reference, or adds facts of its own;
abstained - it says that the answer was not found.
Numbers, dates and names must agree. Wording and further explanation do not matter."""


def answer_prompt(retrieved: DataFrame, questions: DataFrame, by: list[str]) -> DataFrame:
    """One prompt for each question from its ranked chunks (rank, text, score) alone."""
    block = F.format_string(fixed.ANSWER_BLOCK, "rank", "score", "text")
    ctx = retrieved.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("bs"))
    rows = questions.join(ctx, by, "left")
    context = F.coalesce(F.nullif(F.concat_ws("\n\n", F.transform("bs", lambda x: x["b"])), F.lit("")), F.lit(fixed.NO_CONTEXT))
    return rows.withColumn("prompt", filled(fixed.ANSWER_PROMPT, context=context, question=F.col("question"))).drop("bs")


def filled(template: str, **columns: Column) -> Column:
    """A template with its {names} replaced by columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(columns[x] if i % 2 else F.lit(x) for i, x in enumerate(parts)))


def judge_prompt(question: Column, reference: Column, answer: Column) -> Column:
    return filled(fixed.JUDGE_PROMPT, question=question, reference=reference, answer=answer)


def _strip(c: Column) -> Column:
    return text.strip(F.coalesce(c, F.lit("")))


def parse_answer(raw: Column) -> Column:
    """struct(answer, abstained, quoted): what follows the first Used: on a line of its own start is
    split off, its next words on a line are the quote; NOT_FOUND anywhere before it abstains;
    preambles and quotes around the answer are stripped."""
    t = _strip(raw)
    used = r"(?m)^\s*Used:\s*(\S.*)$"
    quoted = _strip(F.regexp_extract(t, used, 1))
    body = F.when(t.rlike(used), _strip(F.regexp_replace(t, r"(?ms)^\s*Used:\s*\S.*\z", ""))).otherwise(t)
    gone = F.contains(F.upper(body), F.lit("NOT_FOUND"))
    clean = _strip(F.regexp_replace(body, r"(?i)^(answer|the answer is)\s*[:\-]\s*", ""))
    clean = _strip(F.regexp_replace(clean, r'^"+|"+$', ""))
    answer = F.when(gone, "NOT_FOUND").otherwise(clean)
    return F.struct(answer.alias("answer"), (gone | (clean == "")).alias("abstained"), quoted.alias("quoted"))


def parse_verdict(raw: Column, abstained: Column) -> Column:
    """A verdict from JSON, from braces in prose, else the first verdict word; what cannot be
    read is never correct."""
    t = _strip(raw)
    whole = F.try_parse_json(t)
    obj = F.coalesce(whole, F.try_parse_json(F.regexp_extract(t, r"(?s)\{.*\}", 0)))
    said = F.replace(F.lower(F.trim(F.try_variant_get(obj, "$.verdict", "string"))), F.lit(" "), F.lit("_"))
    low = F.lower(t)
    word = F.when(F.contains(low, F.lit("partially_correct")) | F.contains(low, F.lit("partially correct")), "partially_correct")
    for v in fixed.VERDICTS:
        word = word.when(low.rlike(rf"\b{v}\b"), v)
    return F.coalesce(F.when(said.isin(*fixed.VERDICTS), said), word, F.when(abstained, "abstained").otherwise("incorrect"))


def settle(answer: Column, raw_verdict: Column, abstained: Column, failed: Column) -> Column:
    """The verdict of a trial: NOT_FOUND and a failed or truncated judge abstain."""
    return F.when(F.upper(F.trim(answer)) == "NOT_FOUND", "abstained").when(failed, "abstained").otherwise(parse_verdict(raw_verdict, abstained))


def error_class(message: str) -> str:
    """authentication, rate limit, context or provider: by the words of an error."""
    low = message.lower()
    return next((name for name, words in fixed.MODEL_ERRORS if any(w in low for w in words)), "provider")


def retrying(client: Callable, tries: int = fixed.MODEL_TRIES, base: float = fixed.MODEL_BACKOFF, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``client`` with up to ``tries`` calls, base^n seconds after the n-th; then a RuntimeError that
    begins with the class of the last error."""

    def call(request):
        for n in range(tries):
            try:
                return client(request)
            except Exception as e:  # noqa: BLE001 - whatever the client raises is retried
                last = e
            if n + 1 < tries:
                sleep(base**n)
        raise RuntimeError(f"{error_class(str(last))} error after {tries} attempts: {type(last).__name__}: {last}") from last

    return call


def call_key(prompt: Column, model: str, system: str = "", max_tokens: Column | int | None = None, base_url: str | None = None, *more: Column) -> Column:
    """Key of a call in a log: the same prompt to another model, endpoint or limit is another call."""
    limit = max_tokens.cast("string") if isinstance(max_tokens, Column) else F.lit(None if max_tokens is None else str(max_tokens))
    parts = (F.lit(model), F.lit(str(fixed.MODEL_TEMPERATURE)), F.lit(str(fixed.MODEL_SEED)), limit, F.lit(system))
    return text.cache_key(F.lit("llm"), *parts, prompt, F.lit(base_url), *more)
