import json

import pytest

from lensaudit import cli, config
from lensaudit.operators import evals, generate
from lensaudit.streaming import incremental

URL = "https://a.net/"


@pytest.fixture(scope="module")
def snapshot(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("snap"))
    body = "<html><head><title>Some title here</title></head><body><h1>H</h1><p>" + "words and words. " * 100 + "</p></body></html>"
    rows = [("a", u, i, lens, u, 200, {}, body, 1, None, None, [], None) for i, u in enumerate((URL, URL + "docs/x", URL + "docs/y_z")) for lens in ("browser", "GPTBot")]
    spark.createDataFrame(rows, cli.TABLES["fetches"]).write.parquet(f"{path}/fetches")
    spark.createDataFrame([("a", URL, URL)], cli.TABLES["sites"]).write.parquet(f"{path}/sites")
    spark.createDataFrame([("a", "User-agent: GPTBot\nDisallow: /\nSitemap: https://a.net/s.xml\n", False)], cli.TABLES["robots"]).write.parquet(f"{path}/robots")
    return path


def run(spark, *args):
    out = []
    return cli.main(list(args), spark, out.append), "\n".join(out)


def test_audit_formats_and_gate(spark, snapshot, tmp_path):
    code, text = run(spark, "audit", snapshot, "--format", "json", "--now", "2025-01-01")
    doc = json.loads(text)
    assert code == 0 and doc["score"]["overall"] > 50 and {c["check_id"]: c["status"] for c in doc["checks"]}["ACC-001"] == "warn"
    assert run(spark, "audit", snapshot, "--fail-under", "99.9")[0] == 1 and run(spark, "audit", snapshot, "--only", "REN-001", "--fail-under", "99.9")[0] == 0
    assert "access" in run(spark, "audit", snapshot)[1]
    both = ("audit", snapshot, "--format", "json,markdown", "--output", str(tmp_path / "out"))
    assert run(spark, *both)[0] == 0 and (tmp_path / "out" / "markdown").is_dir()
    assert run(spark, *both, "--force")[0] == 0


def test_usage_errors(spark, snapshot):
    for args in (["nope"], ["audit", snapshot, "--format", "pdf"], ["audit", snapshot, "--format", "json,markdown"], ["audit", snapshot, "--only", "XYZ"], ["audit", snapshot, "--bots", "nobody"], ["audit", snapshot, "--config", "/none.toml"]):
        assert run(spark, *args)[0] == 2
    assert run(spark, "version") == (0, cli.VERSION)


def test_generate(spark, snapshot):
    assert "Sitemap: https://a.net/s.xml" in run(spark, "generate", "robots", snapshot)[1]
    text = run(spark, "generate", "llms-txt", snapshot)[1]
    assert text.index("## Overview") < text.index("## Docs") and f"- [Some title here]({URL})" in text
    doc = json.loads(run(spark, "generate", "jsonld", snapshot)[1])
    assert doc["name"] == "Some title here" and doc["url"] == URL
    with pytest.raises(ValueError):
        generate.agents("none")
    assert generate.agents("allow-all") == [] and "GPTBot" in generate.agents("block-all-ai")


def test_config_layers(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text('[audit]\nmax_pages = 7\nbots = ["GPTBot"]\n[eval]\ntrials = 5\n')
    cfg = config.load(str(f), {"LENSAUDIT_TRIALS": "2", "LENSAUDIT_POLICY": "fail"})
    assert (cfg.audit.max_pages, cfg.audit.bots, cfg.audit.policy, cfg.eval.trials, cfg.sources) == (7, ("GPTBot",), "fail", 2, ("defaults", str(f), "env"))
    assert config.override(cfg, {"audit": {"policy": None}}, "flags") == cfg
    for bad in ('[audit]\nmax_pages = "x"\n', "[audit]\nnope = 1\n", "[other]\nx = 1\n", '[eval]\napi_key = "sk-1"\n', "[audit\n", "[audit]\nmax_pages = 0\n"):
        f.write_text(bad)
        with pytest.raises(config.ConfigError):
            config.load(str(f), {})


def test_gates(spark):
    rows = spark.createDataFrame([("a", 62.0, 55.0, 69.0, "high"), ("b", 62.0, 42.0, 82.0, "high"), ("c", 20.0, 10.0, 30.0, "low"), ("d", 80.0, 75.0, 85.0, "high")], "k string, mean double, ci_low double, ci_high double, confidence string")
    assert [r.fails for r in evals.gate(rows, 70.0, 10.0).orderBy("k").collect()] == [True, False, False, False]
    assert [r.fails for r in evals.gate(rows, 70.0, 10.0, strict=True).orderBy("k").collect()] == [True, True, True, False]
    assert [r.note for r in evals.gate(rows, 70.0, 10.0).orderBy("k").collect()] == ["", "95% CI is ±20 points", "circular ground truth", ""]
    assert not any(r.fails for r in evals.gate(rows, None).collect())


def test_small_evaluations(spark):
    def trials(*verdicts, span=True):
        rows = [("s", "u", q, t, v, True, span, None) for t, vs in enumerate(verdicts) for q, v in enumerate(vs)]
        return spark.createDataFrame(rows, "site_id string, url string, q_id long, trial int, verdict string, span_hit boolean, has_span boolean, error string")

    mixed = trials(["correct"] * 4, ["abstained"] * 4, ["correct"] * 4)
    page = evals.page_results(mixed).collect()[0]
    assert round(page["mean"], 3) == 66.667 and page["per_trial_stddev"] > 0 and page["context_recall"] == 1.0
    partial = evals.page_results(trials(["correct", "partially_correct", "incorrect", "abstained"], span=False)).collect()[0]
    assert partial["mean"] == 37.5 and partial["context_recall"] is None and partial["per_trial_stddev"] == 0.0
    assert evals.site_results(trials(["correct"], span=False)).collect()[0]["context_recall"] == 0.0
    assert {r.likely_cause for r in evals.failures(trials(["abstained"], ["abstained"])).collect()} == {"content_ambiguous"}


def test_repeats_in_a_stream_are_dropped(spark, tmp_path):
    base = ("s", "u", 0, "browser", "u", 200, None, "body", 1, None, None, None, None)
    from datetime import datetime

    rows = [(*base, datetime(2025, 1, 1, 0, i)) for i in range(3)]
    spark.createDataFrame(rows, incremental.SNAPSHOT).write.parquet(str(tmp_path / "in"))
    new = incremental.fresh(incremental.snapshots(spark, str(tmp_path / "in")))
    incremental.audit_batches(new, lambda d: d.select("site_id", "body_sha"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert incremental.verdicts(spark, str(tmp_path / "out")).count() == 1


def test_a_site_in_two_batches_has_one_verdict(spark, tmp_path):
    from datetime import datetime

    from pyspark.sql import functions as F

    row = lambda site, pos: (site, f"u{pos}", pos, "browser", "u", 200, None, f"b{pos}", 1, None, None, None, None, datetime(2025, 1, 1))
    judge = lambda d: d.groupBy("site_id").agg(F.count(F.lit(1)).alias("pages"))
    at = {k: str(tmp_path / k) for k in ("in", "out", "ck")}
    for rows in ([row("s", 0), row("t", 0)], [row("s", 1)]):
        spark.createDataFrame(rows, incremental.SNAPSHOT).write.mode("append").parquet(at["in"])
        incremental.audit_batches(incremental.snapshots(spark, at["in"]), judge, at["out"], at["ck"]).awaitTermination()
    assert sorted(map(tuple, incremental.verdicts(spark, at["out"]).collect())) == [("s", 2), ("t", 1)]


def test_title_case_is_pythons(spark):
    from pyspark.sql import functions as F

    from lensaudit.functions import text

    words = ["it's a 3d-print", "élan vital", "ABC def", "", "a1b2 c", "über-uns"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(text.title_case(F.col("w"))).collect()
    assert [r[0] for r in got] == [w.title() for w in words]


def test_costs_and_codes(spark, snapshot):
    ask = ("audit", snapshot, "--model", "openai/gpt-4o-mini")
    code, text = run(spark, *ask, "--dry-run")
    assert code == 0 and "a: 450 answers" in text and "$0." in text
    assert run(spark, *ask, "--max-cost", "0.0001")[0] == 5 and run(spark, "audit", snapshot, "--model", "nobody/x", "--max-cost", "9", "--dry-run")[0] == 5
    assert run(spark, "audit", snapshot, "--model", "nobody/x", "--max-cost", "9", "--input-cost-per-mtok", "1", "--output-cost-per-mtok", "1", "--dry-run")[0] == 0
    assert run(spark, "audit", snapshot, "--questions", "201")[0] == 2


def test_schema_fits_a_report(spark, snapshot):
    schema = json.loads(run(spark, "schema")[1])
    doc = json.loads(run(spark, "audit", snapshot, "--format", "json", "--only", "DIS-003")[1])
    assert set(schema["properties"]) == set(doc) and set(schema["properties"]["checks"]["items"]["properties"]) == set(doc["checks"][0])
    assert run(spark, "doctor")[0] == 0 and run(spark, "telemetry")[0] == 0


def test_ids_and_telemetry(spark):
    from lensaudit.operators import usage

    assert usage.ulid(0, 0) == "0" * 26 and usage.ulid(1, 31) == "0000000001" + "0" * 15 + "Z" and usage.ulid(2**48 - 1, 0)[:10] == "7ZZZZZZZZZ"
    cases = (({}, None, "", False), ({}, True, "x", True), ({}, True, "", False), ({"CI": "1"}, True, "x", False), ({"CI": "1", "LENSAUDIT_TELEMETRY": "1"}, None, "", True), ({"DO_NOT_TRACK": "1", "LENSAUDIT_TELEMETRY": "1"}, True, "x", False), ({"LENSAUDIT_TELEMETRY": "0"}, True, "x", False))
    assert [usage.telemetry(env, s, e)[0] for env, s, e, _ in cases] == [w for *_, w in cases]
    row = usage.events(spark.createDataFrame([("run", 7, 999_000, "https://a")], "event string, pages int, duration_ms long, url string")).collect()[0]
    assert row.asDict() == {"event": "run", "pages_bucket": "6-10", "duration_bucket": "30-120s"}
