"""Registered queries: each applies an operator to a driver table, or to the simulated crawl
over ``pages`` where the tables lack what it reads (see ``simulate``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed
from ..functions import dates, numbers, urls
from ..functions import html as H
from ..functions import text as T
from ..operators import catalog, checks, chunking, cost, eval_run, evals, generate, judging, questions, report, retrieval, scoring
from ..sources import crawl as C
from ..sources import robots as R
from ..sources import shared
from ..sources import sitemap as S
from . import audit
from . import simulate as sim

NOW = "2025-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark, sf_dir):
    return sim.pages(table(spark, sf_dir, "pages"))


def crawl(spark: SparkSession, sf_dir: str, keep: bool = False) -> C.Crawl:
    pages = _pages(spark, sf_dir)
    sites = sim.sites(pages)
    fetches = sim.fetches(pages).unionByName(sim.rendered(pages).select(sim.fetches(pages).columns))
    none = spark.createDataFrame([], "site_id string, error string")
    return audit.build(sites, fetches, sim.robots(sites), sim.sitemap_entries(pages), none, sim.llms(sites), F.lit(NOW).cast("timestamp"), keep=keep)


def _short(df: DataFrame) -> DataFrame:
    return df.select("site_id", "check_id", "status", "weight", "points", "confidence")


def _check(check_id: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _short(checks.CHECKS[check_id](crawl(spark, sf_dir)))

    return run


def _facts(df: DataFrame, **fields: str) -> DataFrame:
    """site_id and some fields of a check's evidence: output name = path and type."""
    return df.select("site_id", *(F.get_json_object("evidence", f"$.{at.split()[0]}").cast(at.split()[1]).alias(name) for name, at in fields.items()))


def access_evidence(spark, sf_dir):
    """Evidence lists, medians, arguments of the least and HSTS ages of five checks."""
    c = crawl(spark, sf_dir)
    run = lambda i: checks.CHECKS[i](c)
    rules = run("ACC-001").select("site_id", F.array_join(F.from_json(F.get_json_object("evidence", "$.blocked"), "array<string>"), ",").alias("blocked"), F.array_join(F.transform(F.from_json(F.get_json_object("evidence", "$.by_purpose"), "array<struct<purpose: string, bot: string>>"), lambda x: F.concat_ws(":", x["purpose"], x["bot"])), ",").alias("by_purpose"))
    rows = rules.join(_facts(run("SITE-001"), hsts_max_age="hsts_max_age long", hops="hops long"), "site_id")
    rows = rows.join(_facts(run("REN-001"), worst_page="worst_page string", small="small long"), "site_id")
    return rows.join(_facts(run("REN-002"), median_chars="median_chars long", thin="thin long"), "site_id").join(_facts(run("ACC-003"), blocked_responses="blocked long", responses="total long"), "site_id")


def structure_evidence(spark, sf_dir):
    """The counts that the structure checks report."""
    c = crawl(spark, sf_dir)
    want = {
        "STR-002": {"pages": "pages", "description_missing": "missing", "description_out": "out_of_range"}, "STR-003": {"canonical_absent": "absent", "canonical_odd": "odd"}, "STR-004": {"h1_none": "none", "h1_multiple": "multiple", "h1_empty": "empty"},
        "STR-005": {"headings_none": "without", "headings_bad": "bad", "headings_worse": "worse"}, "STR-006": {"lang_absent": "absent", "lang_invalid": "invalid"}, "SD-001": {"ld_none": "without", "ld_unparsed": "unparsed", "ld_untyped": "untyped"}, "SD-003": {"og_none": "without", "og_problems": "problems"},
    }
    rows = None
    for check, fields in want.items():
        got = _facts(checks.CHECKS[check](c), **{k: f"{v} long" for k, v in fields.items()})
        rows = got if rows is None else rows.join(got, "site_id")
    return rows


# Pages


def page_structure(spark, sf_dir):
    html = F.col("html")
    rows = table(spark, sf_dir, "pages").select("page_id", H.title(html).alias("title"), H.lang(html).alias("lang"), H.headings(html).alias("hs"), T.strip_tags(html).alias("stripped"), H.has_main(html).alias("has_main"))
    return rows.select("page_id", "title", "lang", F.size("hs").cast("long").alias("n_headings"), F.try_element_at("hs", F.lit(1))["text"].alias("first_heading"), F.length("stripped").cast("long").alias("stripped_chars"), "has_main")


def heading_outline(spark, sf_dir):
    rows = _pages(spark, sf_dir).select("page_id", H.headings(F.col("html")).alias("hs"))
    return rows.select("page_id", F.array_join(F.transform("hs", lambda h: h["level"].cast("string")), ",").alias("levels"), F.size(H.skipped_levels(F.col("hs"))).cast("long").alias("skipped"), F.size(F.filter("hs", lambda h: h["text"] == "")).cast("long").alias("empty"))


def page_tags(spark, sf_dir):
    from ..sources import html_parser

    rows = html_parser.extract(_pages(spark, sf_dir).select("page_id", "html"))
    return rows.select("page_id", "description", F.col("robots_meta").alias("robots"), F.try_element_at("meta_tags", F.lit("og:image")).alias("og_image"), "canonical", F.col("canonical_count").cast("long").alias("canonical_count"), F.try_element_at("time_datetimes", F.lit(1)).alias("time"), F.size("ld_blocks").cast("long").alias("ld_blocks"), H.valid_lang(F.col("lang")).alias("valid_lang"))


def structured_data(spark, sf_dir):
    from ..sources import structured

    rows = structured.parse(_pages(spark, sf_dir).select("page_id", H.ld_blocks(F.col("html")).alias("b")), "b", "ld")
    return rows.select("page_id", F.col("ld.blocks").cast("long").alias("blocks"), F.col("ld.parsed").cast("long").alias("parsed"), F.array_join("ld.types", ",").alias("types"), F.size("ld.errors").cast("long").alias("errors"))


def props_items(spark, sf_dir):
    """The properties of clicks as two blocks: once with their items as @graph, once as they are."""
    from ..sources import structured

    props = F.col("props")
    blocks = F.when(props.isNotNull(), F.array(F.replace(props, F.lit('"items"'), F.lit('"@graph"')), props))
    rows = structured.parse(table(spark, sf_dir, "clicks").select("click_id", blocks.alias("b")), "b", "ld")
    items = F.col("ld.items")
    return rows.select("click_id", F.col("ld.blocks").cast("long").alias("blocks"), F.col("ld.parsed").cast("long").alias("parsed"), F.size("ld.errors").cast("long").alias("errors"), F.size(structured.find_items_with(items, ("sku", "tags"))).cast("long").alias("with_keys"), structured.first_value(F.try_element_at(items, F.lit(-1)), "tags").alias("first_tag"), structured.first_value(F.try_element_at(items, F.lit(1)), "sku").alias("first_sku"))


def marker_flags(spark, sf_dir):
    html = F.col("html")
    rows = _pages(spark, sf_dir).select("page_id", H.framework_markers(html).alias("f"), H.shell_markers(html).alias("s"))
    return rows.select("page_id", F.array_join("f", ",").alias("frameworks"), F.array_join("s", ",").alias("shells"), H.looks_like_shell(F.col("f"), F.col("s"), F.when(F.col("page_id") % 2 == 0, 199).otherwise(200)).alias("shell"))


def main_text(spark, sf_dir):
    from ..sources import main_content

    rows = main_content.extract(table(spark, sf_dir, "pages").select("page_id", F.length(F.coalesce("html", F.lit(""))).alias("n"), "html"))
    chars = F.length("text")
    return rows.select("page_id", chars.cast("long").alias("chars"), F.md5("text").alias("text_md5"), F.col("extraction_mode").alias("mode"), F.coalesce(numbers.share(chars, F.col("n"), 5), F.lit(0.0)).alias("ratio"))


def main_blocks(spark, sf_dir):
    """Pages whose navigation and advertisement are plain divs: told by their links and neighbours."""
    from ..sources import main_content

    plain = F.replace(F.replace(F.replace("html", F.lit("nav>"), F.lit("div>")), F.lit(' class="ad"'), F.lit("")), F.lit("footer>"), F.lit("div>"))
    rows = main_content.blocks(table(spark, sf_dir, "pages").select("page_id", plain.alias("html")))
    return rows.select("page_id", "block", "level", "kind", "chars", "link_chars", F.md5("text").alias("text_md5"), "recall", "precision")


def parsed_pages(spark, sf_dir):
    from ..sources import html_parser

    rows = html_parser.extract(_pages(spark, sf_dir).select("page_id", "html"))
    return rows.select("page_id", "title", "lang", F.size("headings").cast("long").alias("n_headings"), F.col("canonical_count").cast("long").alias("canonical_count"), "description", F.size("ld_blocks").cast("long").alias("ld_blocks"))


def url_parts(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.scheme(u).alias("scheme"), urls.netloc(u).alias("host"), urls.path(u).alias("path"), urls.segment(u).alias("segment"), urls.normalize(F.regexp_replace(u, "^https?://", "")).alias("normal"), urls.same_origin(u, F.lit("http://ththre.example.com/")).alias("same_origin"), urls.role(urls.path(u), F.lit(None).cast("string"), F.array().cast("array<string>")).alias("role"))


def cache_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.cache_key(F.lit("fetch"), F.col("url")).alias("key"))


# Fetches


def lens_fetches(spark, sf_dir):
    rows = C.classify(sim.fetches(_pages(spark, sf_dir)))
    return rows.groupBy("lens", "status", "blocked_by", "challenge_marker").agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("errors"))


def lens_plan(spark, sf_dir):
    return C.lens_urls(table(spark, sf_dir, "pages").select("page_id", "url"), C.bots(spark)).groupBy("lens").agg(F.count(F.lit(1)).alias("fetches"))


def parity_rows(spark, sf_dir):
    return checks.parity_rows(crawl(spark, sf_dir)).select("url", "bot", "status_match", "size_ratio", "similarity", "diverged")


def parity_by_bot(spark, sf_dir):
    rows = checks.parity_rows(crawl(spark, sf_dir))
    return rows.groupBy("bot").agg(F.count(F.lit(1)).alias("pages"), F.count_if(~F.col("status_match")).alias("other_status"))


def robots_verdicts(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    asks = pages.select("site_id", F.coalesce(F.nullif(urls.path(F.col("url")), F.lit("")), F.lit("/")).alias("path")).distinct().crossJoin(F.broadcast(C.bots(spark).select("bot", "token")))
    return R.verdicts(sim.robots(sim.sites(pages)), asks).select("site_id", "bot", "path", "verdict", "robots_present")


def robots_posture(spark, sf_dir):
    return R.posture(crawl(spark, sf_dir).verdicts)


def sitemap_files(spark, sf_dir):
    files = sim.sitemap_files(_pages(spark, sf_dir))
    rows = S.read(files, ["page_id"]).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("i", "kind", "loc", "lastmod"))).alias("r"), F.count("error").alias("errors"))
    told = lambda kind: F.array_join(F.transform(F.filter("r", lambda x: x["kind"] == kind), lambda x: F.concat_ws(" ", x["loc"], x["lastmod"])), "\n").alias({"entry": "entries", "child": "children"}[kind])
    usable = files.select("page_id", S.looks_like_sitemap(F.col("body")).alias("usable"))
    return usable.join(rows, "page_id").select("page_id", "usable", told("entry"), told("child"), F.col("errors").cast("int").alias("errors"))


def statuses_by_bot(spark, sf_dir):
    return C.statuses_by_bot(crawl(spark, sf_dir).fetches)


def sitemap_report(spark, sf_dir):
    return crawl(spark, sf_dir).sitemap


def sitemap_sample(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    rows = sim.sitemap_entries(pages).join(sim.sites(pages), "site_id").select("site_id", "start_url", "pos", F.col("loc").alias("url"))
    return S.sample(rows, 4)


def sitemap_candidates(spark, sf_dir):
    sites = sim.sites(_pages(spark, sf_dir))
    named = sites.select("site_id", F.posexplode(F.array(F.concat(F.lit("http://"), "site_id", F.lit("/sitemap.xml")), F.lit("https://cdn.example.org/s.xml"), F.concat(F.lit("http://"), "site_id", F.lit("/news.xml")))).alias("pos", "url"))
    return S.candidates(sites, named)


def date_values(spark, sf_dir):
    rows = sim.sitemap_entries(_pages(spark, sf_dir)).select(F.col("pos").cast("long").alias("page_id"), "lastmod")
    return rows.select("page_id", dates.parse_date(F.col("lastmod")).alias("parsed"), dates.is_stale(F.col("lastmod"), F.lit(NOW).cast("timestamp")).alias("stale"))


def blocked_addresses(spark, sf_dir):
    """Whether the addresses that documents name might be fetched."""
    found = F.explode(F.regexp_extract_all("text", F.lit(r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b"), F.lit(0)))
    rows = table(spark, sf_dir, "documents").select("doc_id", found.alias("ip")).groupBy("ip").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))
    return rows.withColumn("blocked", urls.blocked_address(F.col("ip")))


# Roles, scores, findings


def role_types(spark, sf_dir):
    return checks.role_rows(crawl(spark, sf_dir)).select("url", "role", F.array_join(F.array_sort("types"), ",").alias("types"), F.array_join("missing", ",").alias("missing"))


def author_signals(spark, sf_dir):
    return checks.author_rows(crawl(spark, sf_dir)).select("url", "source", "value")


def page_dates(spark, sf_dir):
    return checks.page_dates(crawl(spark, sf_dir)).select("url", F.col("dates").cast("long").alias("dates"), F.col("unparseable").cast("long").alias("unparseable"))


def _results(spark, sf_dir, only=()):
    """Sites and their results, which are written once: scores and reports read them more than once."""
    c = crawl(spark, sf_dir, keep=True)
    made, at = audit.run(c, only=only), shared.work_dir(spark, "results")
    made.write.parquet(at)
    audit.release(c)
    return c.sites, spark.read.schema(made.schema).parquet(at)


def scores(spark, sf_dir):
    cats = scoring.category_scores(_results(spark, sf_dir, fixed.SCORED_CATEGORIES)[1])
    return cats.join(scoring.overall(cats), "site_id")


def _recorded(spark, sf_dir):
    """Made-up results: a row for each document and check of a catalogue slice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("site_id"))
    rows = docs.join(F.broadcast(catalog.catalog(spark)), F.expr("pmod(doc_id, 20) = ord"))
    status = F.expr("CASE pmod(doc_id div 20, 6) WHEN 0 THEN 'pass' WHEN 1 THEN 'warn' WHEN 2 THEN 'fail' WHEN 3 THEN 'skip' WHEN 4 THEN 'error' ELSE 'pass' END")
    rows = rows.withColumn("status", status)
    return rows.select("doc_id", F.concat_ws("/", "site_id", F.expr("doc_id div 2000")).alias("site_id"), "check_id", "category", "weight", "status", catalog.points(F.col("status"), F.col("weight")).alias("points"))


def category_scores(spark, sf_dir):
    return scoring.category_scores(_recorded(spark, sf_dir))


def overall_scores(spark, sf_dir):
    return evals.score_gate(scoring.overall(scoring.category_scores(_recorded(spark, sf_dir))), 60.0)


def status_counts(spark, sf_dir):
    return scoring.status_counts(_recorded(spark, sf_dir))


def top_findings(spark, sf_dir):
    results = _recorded(spark, sf_dir)
    one = results.groupBy("site_id", "check_id", "weight").agg(F.max("status").alias("status"))
    return scoring.top_findings(one, 8).select("site_id", "check_id", "status", "rank")


def calibration(spark, sf_dir):
    got = _recorded(spark, sf_dir).groupBy("site_id", "check_id").agg(F.max("status").alias("status"))
    want = got.select("site_id", "check_id", F.lit("warn").alias("status"), (F.length("site_id") % 2 == 0).alias("known_good"))
    return scoring.calibration(got, want)


def llms_sections(spark, sf_dir):
    c = crawl(spark, sf_dir)
    return generate.sections(generate.page_entries(c.views, c.structure, c.sites)).select("site_id", "ord", F.col("pages").cast("long").alias("pages"))


def generated_robots(spark, sf_dir):
    rows = generate.robots_txt(sim.sites(_pages(spark, sf_dir)))
    return rows.select("site_id", (F.size(F.split("content", "Disallow: /\n")) - 1).cast("long").alias("denied"), F.contains("content", F.lit("Allow: /")).alias("allows"))


def generated_json_ld(spark, sf_dir):
    sites = sim.sites(_pages(spark, sf_dir)).select("site_id", "start_url", F.expr("CASE WHEN length(site_id) % 2 = 0 THEN site_id END").alias("title"), F.lit("").alias("description"))
    rows = generate.json_ld(spark, "Organization", sites)
    return rows.select("site_id", F.get_json_object("content", "$.name").alias("name"), F.get_json_object("content", "$.url").alias("url"), F.array_join("missing", ",").alias("missing"))


# Text and retrieval


def jaccard_docs_benchmark(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("a"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("b"), "text")
    rows = retrieval.similarity_pairs(docs, items)
    return rows.groupBy("b").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.sum("similarity"), 4).alias("total"), F.round(F.max("similarity"), 6).alias("best"))


def question_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    return questions.dedupe(rows.withColumn("by", F.lit(0)), ["by"], ["conv_id", "turn"]).select("conv_id", "turn", "question")


def question_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("question"), F.expr("repeat('a', cast(doc_id % 12 as int))").alias("reference_answer"), F.expr("CASE WHEN doc_id % 3 = 0 THEN 'not there at all' ELSE text END").alias("source_span"), F.col("text").alias("ground_truth"))
    return questions.post_filter(rows, ["doc_id"], ["doc_id"]).select("doc_id", (F.col("source_span") != "").alias("has_span"))


def generation_budget(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", questions.token_budget(F.lit(50), F.length("text")).cast("long").alias("budget"), T.approx_tokens(F.col("text")).cast("long").alias("tokens"))
    return rows


def chunk_docs(spark, sf_dir):
    rows = chunking.chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("tokens").alias("tokens"), F.max(F.length("text")).cast("long").alias("longest"))


def prepared_docs(spark, sf_dir):
    rows = chunking.prepare(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return rows.groupBy("mode").agg(F.countDistinct("doc_id").alias("docs"), F.count(F.lit(1)).alias("chunks"))


def _chunked(spark, sf_dir):
    """Documents as chunks of a page for each source."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("page"), F.col("doc_id").alias("chunk_idx"), F.lit("").alias("heading_path"), "text")


def _asks(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    return items.select(F.concat(F.lit("src"), F.col("item_id") % 20).alias("page"), F.col("item_id").alias("q_id"), F.col("text").alias("question"))


def lexical_top_k(spark, sf_dir):
    rows = retrieval.lexical_top_k(_asks(spark, sf_dir), _chunked(spark, sf_dir), ["page"])
    return rows.select("q_id", "rank", F.col("chunk_idx").alias("doc_id"), F.round("score", 9).alias("score"))


def lexical_top_k_corpus(spark, sf_dir):
    rows = retrieval.lexical_top_k_corpus(_asks(spark, sf_dir), _chunked(spark, sf_dir), ["page"])
    return rows.select("q_id", "rank", "page", F.col("chunk_idx").alias("doc_id"), F.round("score", 9).alias("score"))


def vector_top_k(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("label").alias("page"), "vec_id", F.col("embedding").alias("vector"))
    rows = retrieval.vector_top_k(v.withColumnRenamed("vec_id", "q_id"), v.withColumnRenamed("vec_id", "chunk_idx"), ["page"])
    return rows.select("q_id", "rank", F.col("chunk_idx").alias("vec_id"), F.round("score", 6).alias("score"))


def span_recall(spark, sf_dir):
    lines = _chunked(spark, sf_dir)
    asks = _asks(spark, sf_dir).withColumn("source_span", F.expr("CASE WHEN q_id % 5 < 4 THEN question ELSE '' END"))
    found = retrieval.lexical_top_k(asks, lines, ["page"])
    return retrieval.span_hits(asks, found, lines, ["page"]).select("q_id", "has_span", "span_hit")


def parsed_answers(spark, sf_dir):
    raw = F.expr("CASE turn % 4 WHEN 0 THEN concat('Answer: ', text) WHEN 1 THEN concat(text, '\\nUsed: [1]') WHEN 2 THEN 'not_found' ELSE '\"quoted\"' END")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", judging.parse_answer(raw).alias("a"))
    return rows.select("conv_id", "turn", "a.answer", "a.abstained", "a.quoted")


def parsed_verdicts(spark, sf_dir):
    raw = F.expr("CASE turn % 5 WHEN 0 THEN '{\"verdict\": \"Correct\"}' WHEN 1 THEN 'So: {\"verdict\": \"partially correct\"} done' WHEN 2 THEN 'this is incorrect' WHEN 3 THEN '' ELSE 'it is abstained' END")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", judging.parse_verdict(raw, F.col("conv_id") % 2 == 0).alias("verdict"))


# Evaluation


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up trials: three for each document."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("site_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("trial"))
    h = F.expr("(doc_id * 7 + trial * 3) % 10")
    verdict = F.when(h < 5, "correct").when(h == 5, "partially_correct").when(h < 8, "incorrect").otherwise("abstained")
    span = F.expr("doc_id % 4 <> 0")
    return rows.select("site_id", F.concat(F.lit("p"), F.col("doc_id") % 3).alias("url"), F.col("doc_id").alias("q_id"), "trial", verdict.alias("verdict"), (span & F.expr("doc_id % 3 <> 0")).alias("span_hit"), span.alias("has_span"), F.expr("CASE WHEN (doc_id + trial) % 17 = 0 THEN 'boom' END").alias("error"))


def eval_trials(spark, sf_dir):
    return evals.by_trial(trials(spark, sf_dir)).select("site_id", "url", "trial", "n", "points", "abstained", "wrong", "hits", "spans", "score")


def eval_pages(spark, sf_dir):
    return evals.page_results(trials(spark, sf_dir))


def eval_sites(spark, sf_dir):
    return evals.site_results(trials(spark, sf_dir))


def eval_failures(spark, sf_dir):
    return evals.failures(trials(spark, sf_dir)).groupBy("site_id", "likely_cause").agg(F.count(F.lit(1)).alias("n"))


def headed(spark, sf_dir):
    """Documents with headings put between their lines: every seventh line of a text is one, of a
    level by its place; every third document has none."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when((F.col("doc_id") % 3 != 0) & (i % 7 == 6), F.concat(F.repeat(F.lit("#"), (i % 3 + 1).cast("int")), F.lit(" Part "), i.cast("string"))).otherwise(x))
    return table(spark, sf_dir, "documents").select(F.col("source").alias("site_id"), F.concat(F.lit("d"), "doc_id").alias("url"), "doc_id", F.array_join(lines, "\n").alias("text"))


def chunk_rows(spark, sf_dir):
    """Every chunk of documents with headings, in full."""
    rows = chunking.chunks(headed(spark, sf_dir), ["doc_id"], target=60, overlap=20)
    return rows.select("doc_id", "chunk_idx", "heading_path", "tokens", F.length("text").cast("long").alias("chars"), F.md5("text").alias("md5"))


def _eval(spark, sf_dir):
    """One question about each document, from its own words; answers and verdicts are recorded, by
    arithmetic on the id and trial, with errors, cut-off answers, abstentions and prose."""
    docs = table(spark, sf_dir, "documents").where("trim(text) <> ''").select(F.col("source").alias("site_id"), F.concat(F.lit("d"), "doc_id").alias("url"), F.col("doc_id").alias("q_id"), "text")
    asks = docs.select("site_id", "url", "q_id", F.substring("text", 1, 60).alias("question"), F.substring("text", 61, 40).alias("reference_answer"), F.expr("CASE WHEN q_id % 4 = 0 THEN '' ELSE substring(text, 100, 80) END").alias("source_span"))
    cells = asks.select("site_id", "url", "q_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("trial"))
    h, j = F.expr("(q_id * 7 + trial * 3) % 10"), F.expr("(q_id + trial) % 5")
    said = F.when(h < 6, "Answer: yes\nUsed: [1]").when(h == 6, "not_found here").when(h == 9, "").otherwise("half an ans")
    answers = cells.withColumns({"completion": said, "truncated": h == 8, "error": F.when(h == 7, "provider error")})
    grades = cells.withColumns({"completion": F.when(j == 0, '{"verdict": "correct"}').when(j == 1, "it is partially correct").when(j == 2, 'Well: {"verdict": "Incorrect"}.').otherwise("??"), "truncated": F.lit(False), "error": F.when(j == 4, "rate limit")})
    return eval_run.run(docs.select("site_id", "url", "text"), asks, eval_run.recorded(answers), eval_run.recorded(grades), shared.work_dir(spark, "eval"), k=2)


def eval_outcomes(spark, sf_dir):
    done = _eval(spark, sf_dir)
    rows = done.outcomes.join(done.asked.select("site_id", "url", "q_id", F.length("prompt").cast("long").alias("prompt_chars")), ["site_id", "url", "q_id"])
    return rows.select("q_id", "trial", "answer", "abstained", "quoted", "verdict", "has_span", "span_hit", (F.col("error").isNotNull()).alias("failed"), "prompt_chars")


def eval_answers(spark, sf_dir):
    """The whole evaluation, pages to site metrics; each trial's score and the failures in full, as texts and their MD5."""
    rows = eval_run.results(_eval(spark, sf_dir))
    scores = F.array_join(F.transform("per_trial", lambda x: F.round(x * 100).cast("long").cast("string")), ",")
    lost = F.transform("failures", lambda f: F.concat_ws("|", f["url"], f["question"], f["reference_answer"], F.concat_ws(",", F.transform(f["outcomes"], lambda o: o)), f["span_hit"].cast("string"), f["likely_cause"]))
    return rows.select("site_id", "mean", "per_trial_stddev", "ci_low", "ci_high", "question_trials", "abstention_rate", "hallucination_rate", "context_recall", "retrieval_gap", "coverage_loss", "pages", "trials", "chunk_count", "mode", F.col("n_failures").cast("long").alias("n_failures"), F.md5(scores).alias("per_trial"), F.md5(F.array_join(lost, "\n")).alias("failures"))


def eval_gate(spark, sf_dir):
    rows = evals.site_results(trials(spark, sf_dir)).withColumn("confidence", F.when(F.length("site_id") == 4, "low").otherwise("high"))
    return evals.gate(rows, 60.0, margin=8.0).select("site_id", "fails", (F.col("note") != "").alias("noted"))


def ci95_by_lang(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    agg = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("quality").cast("double")).alias("rate"))
    lo, hi = numbers.ci95(F.col("rate"), F.col("n"))
    return agg.select("lang", "n", F.round(lo, 6).alias("low"), F.round(hi, 6).alias("high"), numbers.bucket(F.col("n"), [(50, "small"), (200, "some"), (1e9, "many")]).alias("size"))


def cost_estimate(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", "text", (F.col("doc_id") % 7).alias("chunks"))
    return cost.exceeds(cost.estimate(rows, ["source"], 50, 3, (0.15, 0.60)), 0.5).withColumn("cost_usd", F.round("cost_usd", 3))


def price_lookup(spark, sf_dir):
    """What reading every document of a source would cost by the model that it is dealt to."""
    names = ["gpt-4o-mini", "openai/gpt-4o-2024", "glm-5.3-flashx", "groq/llama-3.3-70b-versatile", "unknown-1", "text-embedding-3-small", "nvidia/nemotron-3-embed-1b", "CLAUDE-SONNET-4"]
    model = F.element_at(F.array(*map(F.lit, names)), (F.regexp_extract("source", "[0-9]+$", 0).try_cast("int") % len(names)).cast("int") + 1)
    docs = table(spark, sf_dir, "documents").select("source", model.alias("model"), T.approx_tokens(F.col("text")).cast("long").alias("tokens"))
    rows = cost.price_lookup(docs.groupBy("source", "model").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens")))
    return rows.withColumns({"embedding": cost.is_embedding_model(F.col("model")), "cost_usd": cost.cost(F.col("tokens"), F.lit(0), F.col("input_rate"), F.col("output_rate"))})


def site_reports(spark, sf_dir):
    sites, results = _results(spark, sf_dir, ["access", "rendering"])
    return report.documents(sites, results).select("site_id", F.get_json_object("report", "$.score.overall").cast("double").alias("overall"), F.get_json_object("report", "$.schema_version").alias("version"))


def block_stream(spark, sf_dir):
    """The streaming operator over the simulated fetches, as one bounded stream."""
    from ..streaming import incremental

    base = shared.work_dir(spark, "stream")
    rows = sim.fetches(_pages(spark, sf_dir)).withColumn("fetched_at", F.expr("timestamp'2025-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, pos)"))
    # a row after the last window, so that the watermark passes all others
    end = rows.agg((F.max("fetched_at") + F.expr("INTERVAL 1 MINUTE")).alias("fetched_at"))
    rows.unionByName(end, allowMissingColumns=True).write.parquet(f"{base}/in")
    agg = incremental.block_rates(incremental.snapshots(spark, f"{base}/in"), window="10 seconds", late="5 seconds")
    q = agg.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(agg.schema).parquet(f"{base}/out").where("site_id IS NOT NULL")


QUERIES = {
    f.__name__: f
    for f in (
        access_evidence, structure_evidence, page_structure, heading_outline, page_tags, structured_data, props_items, marker_flags, main_text, main_blocks, parsed_pages, url_parts, cache_keys, lens_fetches, lens_plan, parity_rows, parity_by_bot,
        robots_verdicts, robots_posture, sitemap_files, statuses_by_bot, sitemap_report, sitemap_sample, sitemap_candidates, date_values, blocked_addresses, role_types, author_signals, page_dates, scores,
        category_scores, overall_scores, status_counts, top_findings, calibration, llms_sections, generated_robots, generated_json_ld, jaccard_docs_benchmark, question_dedupe,
        question_filter, generation_budget, chunk_docs, prepared_docs, lexical_top_k, lexical_top_k_corpus, vector_top_k, span_recall, parsed_answers, parsed_verdicts, eval_trials,
        eval_pages, eval_sites, eval_failures, eval_gate, chunk_rows, eval_outcomes, eval_answers, ci95_by_lang, cost_estimate, price_lookup, site_reports, block_stream,
    )
} | {"check_" + i.lower().replace("-", ""): _check(i) for i, *_ in fixed.CATALOG}
