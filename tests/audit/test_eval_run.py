import pytest

from lensaudit.operators import calls, eval_run, judging

PAGE = "# Prices\n" + "The small plan costs ten euros. " * 60 + "\n# Opening\nWe open at nine on weekdays. " + "Come and see us soon. " * 80 + "\n# Team\n" + "Ann leads the team of five. " * 70
ASKS = "site_id string, url string, q_id long, question string, reference_answer string, source_span string"


@pytest.fixture
def asked(spark):
    pages = spark.createDataFrame([("s", "u", PAGE), ("s", "v", "Short page about cats."), ("s", "w", " ")], "site_id string, url string, text string")
    return pages, spark.createDataFrame([("s", "u", 1, "When do you open on weekdays?", "at nine", "We open at nine on weekdays."), ("s", "v", 2, "What is it about?", "cats", "about dogs"), ("s", "w", 3, "Anything there?", "no", "")], ASKS)


def counting(path, reply):
    """A client that notes every call in a file."""
    from lensaudit.operators import calls as c

    def client(r):
        with open(path, "a") as f:
            f.write(repr(r.prompt) + "\n")
        return c.Reply(*reply(r), input_tokens=1000, output_tokens=100)

    return client


def made(path):
    try:
        return open(path).read().split("\n")[:-1]
    except FileNotFoundError:
        return []


def test_from_pages_to_failures(spark, asked, tmp_path):
    pages, asks = asked
    by_plain = lambda f: eval_run.live(calls.Model("m", calls.plain(f), f"{tmp_path}/{f.__name__}", backoff=0.0))

    def answerer(prompt):
        if "What is it about?" in prompt:
            return "half of", True
        return ("Answer: at nine\nUsed:\n  We open" if "We open at nine" in prompt else "NOT_FOUND"), False

    def judge(prompt):
        assert "NOT_FOUND" not in prompt
        return '{"verdict": "correct"}' if "Candidate answer: at nine" in prompt else "incorrect", False

    done = eval_run.run(pages, asks, by_plain(answerer), by_plain(judge), f"{tmp_path}/work", trials=2, k=2)
    got = {(r.q_id, r.trial): r for r in done.outcomes.collect()}
    assert len(got) == 6 and all(got[1, t].verdict == "correct" and got[1, t].span_hit and got[1, t].quoted == "We open" and got[1, t].answer == "at nine" for t in (0, 1))
    assert got[2, 0].verdict == "abstained" and "limit of 4000" in got[2, 0].error and not got[2, 0].span_hit and got[2, 0].abstained
    assert got[3, 1].verdict == "abstained" and got[3, 1].error is None and not got[3, 1].has_span
    assert "(no context was retrieved)" in {r.q_id: r.prompt for r in done.asked.collect()}[3]
    one = eval_run.results(done).collect()[0]
    assert one.per_trial == [100.0, 100.0, 0.0, 0.0, 0.0, 0.0] and one["mode"] == "whole_page" and one.chunk_count == done.chunks.count() and one.trials == 2
    assert [f.url for f in one.failures] == ["v", "w"] and one.failures[0].likely_cause == "content_not_in_crawler_view" and one.n_failures == 2


def test_a_model_is_called_once_for_each_trial(spark, tmp_path):
    """Four questions, three trials: twelve answers and twelve verdicts, over everything that reads them."""
    pages = spark.createDataFrame([("s", "u", PAGE)], "site_id string, url string, text string")
    asks = spark.createDataFrame([("s", "u", i, f"Question {i} about the plan?", "ten euros", "") for i in range(4)], ASKS)
    logs = [f"{tmp_path}/answers", f"{tmp_path}/verdicts"]
    models = [calls.Model("m", counting(logs[0], lambda r: ("Ten euros.", False)), f"{tmp_path}/log", rates=(1.0, 10.0)), calls.Model("j", counting(logs[1], lambda r: ('{"verdict": "correct"}', False)), f"{tmp_path}/log", rates=(1.0, 10.0))]
    for n in range(2):  # the second run finds all in the log
        done = eval_run.run(pages, asks, *map(eval_run.live, models), f"{tmp_path}/work{n}", trials=3)
        row = eval_run.results(done).collect()[0]
        assert row["mean"] == 100.0 and row.question_trials == 12 and done.outcomes.count() == 12
        assert [len(made(x)) for x in logs] == [12, 12] and [len(set(made(x))) for x in logs] == [4, 4]
        use = done.usage.collect()[0]
        assert (use.calls, use.hits, use.failed, use.input_tokens, use.cost_usd) == ((0, 24, 0, 0, 0.0) if n else (24, 0, 0, 24_000, 0.048))


def test_prompts_ask_for_what_is_read(spark, asked, tmp_path):
    """The requests carry system texts, limits and the wish for JSON, and what they ask for is what the parsers read."""
    pages, asks = asked
    seen = f"{tmp_path}/seen"

    def client(r):
        from lensaudit.operators import calls as c

        with open(seen, "a") as f:
            f.write(f"{r.max_tokens} {r.as_json} {'NOT_FOUND' in r.system} {'Used: ' in r.system} {'partially_correct' in r.system}\n")
        return c.Reply("x")

    model = eval_run.live(calls.Model("m", client, f"{tmp_path}/log"))
    eval_run.run(pages, asks, model, model, f"{tmp_path}/work", trials=1)
    assert set(made(seen)) == {"4000 False True True False", "4000 True False False True"}
    row = spark.createDataFrame([('{"verdict": "partially_correct", "rationale": "x"}', "It is.\nUsed: It is so.")], "v string, a string")
    got = row.select(judging.parse_verdict(row.v, row.a == "").alias("v"), judging.parse_answer(row.a).alias("a")).collect()[0]
    assert got.v == "partially_correct" and (got.a.answer, got.a.quoted) == ("It is.", "It is so.")


def test_failed_calls_are_tried_again(spark, tmp_path):
    prompts = spark.createDataFrame([("a",), ("b",), ("b",)], "prompt string")
    log, flag = f"{tmp_path}/log", f"{tmp_path}/flag"

    def client(r):
        import os

        from lensaudit.operators import calls as c

        if r.prompt == "a" and not os.path.exists(flag):
            raise ValueError("Invalid API key")
        return c.Reply(r.prompt.upper())

    model = calls.Model("m", client, log, tries=2, backoff=0.0)
    got = sorted((r.prompt, r.completion, (r.error or "")[:14], r.hit) for r in model.ask(prompts).collect())
    assert got == [("a", None, "authentication", False), ("b", "B", "", False), ("b", "B", "", False)]
    open(flag, "w").close()
    again = model.ask(prompts)
    assert sorted((r.prompt, r.completion, r.hit) for r in again.collect()) == [("a", "A", False), ("b", "B", True), ("b", "B", True)]
    assert {r.completion for r in calls.Model("other", client, log).ask(prompts).collect()} == {"A", "B"} and model.store().newest(spark).count() == 4
    assert calls.usage(again).collect()[0].asDict() == {"calls": 1, "hits": 2, "failed": 0, "input_tokens": 0, "output_tokens": 0, "cost_usd": 0.0}


def test_a_run_stops_at_its_limit_within_a_wave(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(calls, "WAVE", 10)
    seen, ledger = f"{tmp_path}/seen", calls.Ledger(0.02)
    model = calls.Model("m", counting(seen, lambda r: ("x", False)), f"{tmp_path}/log", ledger, rates=(1.0, 0.0))  # a tenth of a cent each
    prompts = spark.createDataFrame([(f"p{i}",) for i in range(200)], "prompt string")
    prompts.write.parquet(f"{tmp_path}/prompts")
    got = model.ask(spark.read.parquet(f"{tmp_path}/prompts")).collect()
    n = len(made(seen))
    assert 20 <= n <= 20 + 2 * 10 and ledger.done() and abs(ledger.spent - n / 1000) < 1e-9
    assert sum(r.completion is not None for r in got) == n and all("limit on cost" in r.error for r in got if r.completion is None)
    assert model.ask(prompts.limit(5)).where("completion IS NULL AND error IS NULL").count() == 0 and len(made(seen)) == n


def test_what_is_not_recorded_is_an_error(spark):
    asks = spark.createDataFrame([("s", "u", 1, 0), ("s", "u", 2, 0)], "site_id string, url string, q_id long, trial int")
    log = spark.createDataFrame([("s", "u", 1, 0, "yes", None, None)], "site_id string, url string, q_id long, trial int, completion string, truncated boolean, error string")
    got = {r.q_id: r for r in eval_run.recorded(log)(asks).collect()}
    assert got[1].completion == "yes" and got[1].error is None and not got[1].truncated and got[2].error == "not recorded"


def test_retries_and_error_classes():
    calls_, slept = [], []

    def flaky(prompt):
        calls_.append(prompt)
        if len(calls_) < 3:
            raise RuntimeError("HTTP 429")
        return "ok", False

    assert judging.retrying(flaky, sleep=slept.append)("p") == ("ok", False) and slept == [1.0, 1.5]

    def bad(prompt):
        raise ValueError("Invalid API key")

    with pytest.raises(RuntimeError, match="^authentication error after 3 attempts: ValueError"):
        judging.retrying(bad, sleep=slept.append)("p")
    assert [judging.error_class(x) for x in ("rate limit", "maximum context length", "boom")] == ["rate limit", "context", "provider"]
