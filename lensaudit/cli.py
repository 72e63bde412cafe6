"""Command line over crawl snapshots in Parquet: crawl, audit, generate, cache, init, schema, doctor,
telemetry, version.

A snapshot folder holds ``sites``, ``fetches``, ``robots``, ``entries``, ``faults`` and
``llms`` as Parquet (columns: see ``plans.audit.build``); absent ones count as empty.
"""

from __future__ import annotations

import argparse
import os
import sys

import pyspark
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config, fixed
from .operators import calls, clients, cost, embedding, evals, generate, providers, report, scoring, usage
from .plans import audit, evaluation
from .sources import crawl as C
from .sources import facts, shared
from .sources import fetch as fetching
from .sources import live
from .sources import robots as R

VERSION = "0.1.0"
#: Beside the tables of a snapshot: answers of models, and vectors.
CALLS, VECTORS = "_calls", "_vectors"
OK, BELOW, USAGE = fixed.EXIT_OK, fixed.EXIT_BELOW, fixed.EXIT_USAGE


class Blocked(Exception):
    """An address that may not be fetched."""


class Unreachable(Exception):
    """A site of which no page was fetched."""


class Refused(Exception):
    """A model that did not accept the key."""


#: Errors and the codes they end with; the first that fits.
CODES = ((Refused, fixed.EXIT_AUTH), (Blocked, fixed.EXIT_BLOCKED), (Unreachable, fixed.EXIT_UNREACHABLE), (cost.UnknownPrice, fixed.EXIT_COST), (cost.OverBudget, fixed.EXIT_COST), (config.ConfigError, USAGE), (KeyError, USAGE), (ValueError, USAGE))
TABLES = {
    "sites": "site_id string, start_url string, final_url string", "fetches": C.FETCHES, "robots": "site_id string, body string, parse_failed boolean", "entries": "site_id string, loc string, lastmod string",
    "faults": "site_id string, error string", "llms": "site_id string, status int, error string, body string",
    "warnings": live.WARNINGS,
}


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    try:
        return spark.read.schema(TABLES[name]).parquet(f"{path}/{name}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], TABLES[name])


def load(spark: SparkSession, path: str, cfg: config.Config, now: str | None = None) -> C.Crawl:
    t = {name: read(spark, path, name) for name in TABLES}
    when = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    return audit.build(t["sites"], t["fetches"], t["robots"], t["entries"], t["faults"], t["llms"], when, cfg.audit.bots or fixed.DEFAULT_BOTS)


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lensaudit")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("audit")
    a.add_argument("path")
    a.add_argument("--config")
    a.add_argument("--policy", choices=config.POLICIES)
    a.add_argument("--only")
    a.add_argument("--skip")
    a.add_argument("--bots")
    a.add_argument("--fail-under", type=float)
    a.add_argument("--now")
    a.add_argument("--format", default="terminal", help="json, markdown, terminal; several by commas need --output")
    a.add_argument("--output")
    a.add_argument("--force", action="store_true")
    g = sub.add_parser("generate")
    g.add_argument("kind", choices=("llms-txt", "robots", "jsonld"))
    g.add_argument("path")
    g.add_argument("--policy", choices=fixed.ROBOT_POLICIES, default="allow-search-block-training")
    g.add_argument("--type", choices=tuple(fixed.JSONLD_SKELETONS), default="Organization")
    a.add_argument("--eval", choices=config.ENABLED, help="whether models answer questions about the pages; auto: if a key is set")
    a.add_argument("--model", help="provider/name of the model that answers")
    a.add_argument("--judge-model", help="another one for the verdicts")
    a.add_argument("--embedding-model", help="retrieval by vectors of this model, not by words")
    a.add_argument("--base-url", help="an endpoint of the common completions protocol")
    a.add_argument("--api-key-env", help="the variable that has its key")
    a.add_argument("--facts", help="YAML with questions and answers")
    a.add_argument("--call-log", help="the folder that keeps the answers of models; the snapshot's _calls if not given")
    a.add_argument("--eval-pages", type=int)
    a.add_argument("--top-k", type=int)
    a.add_argument("--fail-under-eval", type=float)
    a.add_argument("--fail-under-eval-margin", type=float)
    a.add_argument("--strict-eval", action="store_true", default=None)
    a.add_argument("--max-cost", type=float, help="end with code 5 if an evaluation would cost more")
    a.add_argument("--input-cost-per-mtok", type=float)
    a.add_argument("--output-cost-per-mtok", type=float)
    a.add_argument("--questions", type=int)
    a.add_argument("--trials", type=int)
    a.add_argument("--dry-run", action="store_true", help="print the estimate of an evaluation, audit nothing")
    a.add_argument("--snapshot", help="the folder to crawl into, where path is a URL")
    a.add_argument("--max-pages", type=int)
    w = sub.add_parser("crawl", help="fetch sites into a snapshot; a folder that has one goes on from there")
    w.add_argument("url", nargs="+")
    w.add_argument("--output", required=True, help="a folder that driver and executors share")
    w.add_argument("--config")
    w.add_argument("--bots")
    w.add_argument("--max-pages", type=int)
    for c in (a, w):
        c.add_argument("--concurrency", type=int, help="requests that a task has open at once")
        c.add_argument("--timeout", type=float, help="seconds for an answer")
        c.add_argument("--delay", type=float, help="seconds between two requests to a host")
        c.add_argument("--max-bytes", type=int)
        c.add_argument("--allow-private", action="store_true", default=None, help="private addresses may be fetched")
        c.add_argument("--no-cache", action="store_true", help="fetch again what the folder has")
    k = sub.add_parser("cache", help="the tables of a snapshot")
    k.add_argument("path")
    k.add_argument("--clear", action="store_true", help="remove them, so that the next crawl fetches again")
    k.add_argument("--kind", choices=("fetch", "llm", "embed"), help="remove only what was fetched, answered or embedded")
    i = sub.add_parser("init", help="write a settings file")
    i.add_argument("path", nargs="?", default=config.PROJECT_FILE)
    i.add_argument("--force", action="store_true")
    sub.add_parser("schema")
    sub.add_parser("doctor")
    sub.add_parser("telemetry")
    sub.add_parser("version")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=print, get=fetching.http_get, lookup=fetching.resolve, client=None, embed=None) -> int:
    try:
        args = _parser().parse_args(argv)
    except SystemExit as e:
        return USAGE if e.code else OK
    if args.command == "version":
        out(VERSION)
        return OK
    if args.command == "telemetry":
        on, why = usage.telemetry(os.environ)
        out(f"telemetry is {'on' if on else 'off'}: {why}")
        return OK
    if args.command == "doctor":
        found = providers.detect(os.environ)
        out(f"lensaudit {VERSION}, Python {sys.version.split()[0]}, Spark {pyspark.__version__}")
        out(f"model: {found[1]} by {found[0]}" if found else "model: no key of a provider is set")
        return OK
    if args.command == "init":
        try:
            with open(args.path, "w" if args.force else "x", encoding="utf-8") as f:
                f.write(config.starter())
        except OSError as e:
            out(f"error: {e}")
            return USAGE
        out(f"wrote {args.path}")
        return OK
    spark = spark or SparkSession.builder.appName("lensaudit").getOrCreate()
    try:
        if args.command == "generate":
            return _generate(spark, args, out)
        if args.command == "schema":
            out(report.json_schema(spark))
            return OK
        if args.command == "cache":
            return _cache(spark, args, out)
        if args.command == "crawl":
            _crawl(spark, args.url, args.output, args, out, get, lookup)
            return OK
        if args.path.startswith(("http://", "https://")):
            if not args.snapshot:
                raise ValueError("a URL needs --snapshot, the folder to crawl into")
            _crawl(spark, [args.path], args.snapshot, args, out, get, lookup)
            args.path = args.snapshot
        return _audit(spark, args, out, client, embed)
    except tuple(kind for kind, _ in CODES) as e:
        out(f"error: {e}")
        return next(code for kind, code in CODES if isinstance(e, kind))
    except Exception as e:  # noqa: BLE001 - the last resort of a command
        out(f"internal error: {type(e).__name__}: {e}")
        return fixed.EXIT_INTERNAL


def _crawl(spark: SparkSession, start_urls: list[str], path: str, args, out, get, lookup) -> None:
    """Crawl into ``path`` and say what went wrong; raises if an address was refused, or if a site has no page."""
    flags = {"audit": {"bots": args.bots, "max_pages": args.max_pages}, "fetch": {k: getattr(args, k) for k in ("concurrency", "timeout", "delay", "max_bytes", "allow_private")}}
    cfg = config.override(config.load(args.config), flags, "flags")
    limits = fetching.Limits(**{k: v for k, v in vars(cfg.fetch).items() if k != "max_age"})
    sites = spark.createDataFrame([(u, u) for u in dict.fromkeys(start_urls)], "site_id string, start_url string")
    live.snapshot(spark, sites, path, cfg.audit.max_pages, cfg.audit.bots or fixed.DEFAULT_BOTS, get, lookup, limits, 0.0 if args.no_cache else cfg.fetch.max_age)
    for r in spark.read.schema(live.WARNINGS).parquet(f"{path}/warnings").orderBy("site_id", "code", "url").toLocalIterator():
        out(f"{r['severity']}: {r['code']}: {r['url']}: {r['message']}")
    bad = live.reached(spark, path).agg(F.min(F.when(F.col("refused"), F.col("site_id"))).alias("refused"), F.min(F.when(~F.col("reached"), F.col("site_id"))).alias("lost")).collect()[0]
    if bad["refused"]:
        raise Blocked(f"{bad['refused']}: an address may not be fetched")
    if bad["lost"]:
        raise Unreachable(f"{bad['lost']}: no page was fetched")


def _cache(spark: SparkSession, args, out) -> int:
    """Size in bytes of each table of a snapshot; only tables that a crawl or an evaluation writes are removed,
    all or those of a kind: fetched pages, or answers of models."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    kinds = {"fetch": ("_fetched",), "llm": (CALLS,), "embed": (VECTORS,), None: (*live.TABLES, CALLS, VECTORS)}
    for name in (*live.TABLES, CALLS, VECTORS):
        at = jvm.org.apache.hadoop.fs.Path(f"{args.path}/{name}")
        fs = at.getFileSystem(conf)
        if fs.exists(at):
            clear = args.clear and name in kinds[args.kind]
            out(f"{name}: {fs.getContentSummary(at).getLength()} bytes{' removed' if clear else ''}")
            if clear:
                fs.delete(at, True)
    return OK


def _audit(spark: SparkSession, args, out, client, embed) -> int:
    formats = args.format.split(",")
    if bad := set(formats) - set(report.FORMATS):
        raise ValueError(f"unknown formats {', '.join(sorted(bad))}")
    if len(formats) > 1 and not args.output:
        raise ValueError("several formats need --output")
    asked = ("model", "judge_model", "embedding_model", "base_url", "api_key_env", "facts", "call_log", "eval_pages", "questions", "trials", "top_k", "max_cost", "input_cost_per_mtok", "output_cost_per_mtok", "fail_under_eval", "fail_under_eval_margin", "strict_eval")
    flags = {"audit": {"policy": args.policy, "only": args.only, "skip": args.skip, "bots": args.bots, "fail_under": args.fail_under}, "eval": {k: getattr(args, k) for k in asked} | {"enabled": args.eval}}
    cfg = config.override(config.load(args.config), flags, "flags")
    c = load(spark, args.path, cfg, args.now)
    try:
        measured, why = None, _why_not(cfg.eval, args.dry_run, client)
        if not why:
            name, base = _named(cfg.eval)
            _estimate(spark, c, cfg.eval, name, args.dry_run, out)
            if args.dry_run:
                return OK
            measured = _measure(spark, c, cfg.eval, _models(args.path, cfg.eval, name, base, client, embed))
        elif args.eval == "auto":
            out(f"no evaluation: {why}")
        rows = audit.run(c, cfg.audit.policy, cfg.audit.only, cfg.audit.skip).persist()
        try:
            return _report(args, cfg, formats, c, rows, read(spark, args.path, "warnings"), measured, out)
        finally:
            rows.unpersist()
    finally:
        audit.release(c)


def _report(args, cfg: config.Config, formats: list[str], c: C.Crawl, rows: DataFrame, faults: DataFrame, measured: DataFrame | None, out) -> int:
    if args.output:
        report.write(c.sites, rows, formats, args.output, args.force, faults, measured)
    else:
        for r in report.FORMATS[formats[0]](c.sites, rows, faults, measured).orderBy("site_id").toLocalIterator():
            out(r["report"])
    code = OK
    if measured is not None and cfg.eval.fail_under_eval is not None:
        e = F.col("eval")
        gated = measured.select("site_id", e["mean"].alias("mean"), e["ci95"][0].alias("ci_low"), e["ci95"][1].alias("ci_high"), e["confidence"].alias("confidence"))
        gated = evals.gate(gated, cfg.eval.fail_under_eval, cfg.eval.fail_under_eval_margin, cfg.eval.strict_eval)
        for r in gated.where("fails OR note <> ''").orderBy("site_id").toLocalIterator():
            out(f"{r['site_id']}: answerability {r['mean']:.1f} against {cfg.eval.fail_under_eval:.1f}: {'fails' if r['fails'] else 'not judged'}{', ' + r['note'] if r['note'] else ''}")
            code = BELOW if r["fails"] else code
    if cfg.audit.fail_under is None:
        return code
    worst = scoring.overall(scoring.category_scores(rows)).agg(F.min("overall")).collect()[0][0]
    return BELOW if worst is not None and worst < cfg.audit.fail_under else code


def _why_not(e: config.Eval, dry_run: bool, client) -> str | None:
    """Why no evaluation is to run; None if one is."""
    if e.enabled == "false":
        return "it is turned off"
    if e.enabled == "auto" and not dry_run and e.model is None and client is None and providers.detect(os.environ) is None:
        return "no model is named, and no key of a provider is set"
    return None


def _named(e: config.Eval) -> tuple[str, str | None]:
    """(the answerer, its endpoint if one is set): the named model, else that of the first provider whose key is set."""
    found = providers.detect(os.environ)
    name = e.model or (found[1] if found else fixed.PROVIDERS[0][1])
    if "/" not in name:
        raise ValueError(f"{name}: a model is named provider/name, as openai/gpt-4o-mini")
    return name, e.base_url or (found[2] if found and not e.model else None)


def _models(path: str, e: config.Eval, name: str, base: str | None, client, embed) -> tuple[calls.Model, calls.Model, embedding.Embedder | None]:
    """(answerer, judge, embedder), with one log and one ledger."""
    ledger, rates = calls.Ledger(e.max_cost), (e.input_cost_per_mtok, e.output_cost_per_mtok)
    log = e.call_log or f"{path}/{CALLS}"

    def model(name: str) -> calls.Model:
        own = rates if None not in rates else cost.rates(name)
        if client is not None:
            return calls.Model(name, client, log, ledger, own, base)
        url, key = providers.endpoint(name, os.environ, base, e.api_key_env)
        return calls.Model(name, clients.chat(name.partition("/")[2], url, key), log, ledger, own, base)

    vectors = None
    if e.embedding_model:
        ask = embed
        if ask is None:
            url, key = providers.endpoint(e.embedding_model, os.environ, e.base_url, e.api_key_env)
            ask = clients.embed(e.embedding_model.partition("/")[2], url, key)
        vectors = embedding.Embedder(e.embedding_model, ask, f"{path}/{VECTORS}", base)
    return model(name), model(e.judge_model or name), vectors


def _estimate(spark: SparkSession, c: C.Crawl, e: config.Eval, model: str, dry_run: bool, out) -> None:
    """What the evaluation would cost, printed for a dry run; raises above the limit or without a price."""
    if not dry_run and e.max_cost is None:
        return
    given = (e.input_cost_per_mtok, e.output_cost_per_mtok)
    pages = evaluation.first_pages(c.views, "browser-nojs", e.eval_pages)
    pages = pages.select("site_id", "text", F.greatest(F.lit(1), F.ceil(F.length("text") / (4 * fixed.CHUNK_TOKENS))).alias("chunks"))
    estimate = cost.estimate(pages, ["site_id"], e.questions, e.trials, given if None not in given else cost.rates(model))
    cost.enforce(spark.createDataFrame([(model,)], "model string"), estimate, e.max_cost, given)
    if dry_run:
        for r in estimate.orderBy("site_id").toLocalIterator():
            out(f"{r['site_id']}: {r['answer_calls']} answers, {r['input_tokens']} tokens in, {r['output_tokens']} out, ${r['cost_usd']:.4f}")


def _measure(spark: SparkSession, c: C.Crawl, e: config.Eval, models) -> DataFrame:
    """site_id and ``eval`` of each site; raises if a model did not accept the key."""
    answerer, judge, vectors = models
    listed = facts.load(spark, e.facts) if e.facts else None
    plan = evaluation.Plan(answerer, judge, shared.work_dir(spark, "eval"), listed, vectors, e.eval_pages, e.questions, e.trials, e.top_k, e.judge_model is None)
    done, measured = evaluation.run(plan, c)
    refused = done.answers.where(F.col("error").startswith("authentication")).select("error").head()
    if refused:
        raise Refused(refused["error"])
    return measured


def _generate(spark: SparkSession, args, out) -> int:
    c = load(spark, args.path, config.Config())
    if args.kind == "robots":
        docs = generate.robots_txt(c.sites, args.policy, R.sitemaps(c.robots))
    elif args.kind == "llms-txt":
        docs = generate.llms_txt(c.sites, generate.page_entries(c.views, c.structure, c.sites))
    else:
        start = c.structure.join(c.sites, "site_id").where("url = start_url").select("site_id", "title", "description")
        docs = generate.json_ld(spark, args.type, c.sites.join(start, "site_id", "left"))
    for r in docs.orderBy("site_id").toLocalIterator():
        out(r["content"])
    return OK


if __name__ == "__main__":
    sys.exit(main())
