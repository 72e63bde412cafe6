"""The twenty checks: each an aggregation of its rows by site and a first-match verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import dates, numbers, text, urls
from ..functions import html as H
from ..sources.crawl import PAGE, Crawl, ok
from ..sources.structured import text_at
from .catalog import decide



def _count(cond):
    return F.count_if(cond)


def _names(c):
    return F.concat_ws(", ", c)


# Access


def robots_rules(crawl: Crawl, policy: str = "report") -> DataFrame:
    """ACC-001. Blocked bots are a warning under the policy report, a decision under ignore,
    a failure under fail. Purposes of unknown bots are called other."""
    purpose = crawl.verdicts.sparkSession.createDataFrame([(b[0], b[3]) for b in fixed.BOTS], "bot string, purpose string")
    rows = crawl.verdicts.join(F.broadcast(purpose), "bot", "left").withColumn("purpose", F.coalesce("purpose", F.lit("other")))
    blocked = F.col("verdict") == "blocked"
    agg = rows.groupBy("site_id").agg(F.count(F.lit(1)).alias("bots"), F.array_sort(F.collect_list(F.when(blocked, F.col("bot")))).alias("blocked"), F.array_sort(F.collect_set(F.when(blocked, F.struct("purpose", "bot")))).alias("by_purpose"))
    agg = crawl.robots.select("site_id", F.col("body").isNotNull().alias("robots_present"), F.coalesce("parse_failed", F.lit(False)).alias("parse_failed")).join(agg, "site_id", "left")
    agg = agg.withColumn("n_blocked", F.coalesce(F.size("blocked"), F.lit(0)))
    some = F.concat("n_blocked", F.lit(" of "), "bots", F.lit(" bots are blocked by robots.txt ("), _names(F.col("blocked")), F.lit(")."))
    free = F.when(F.col("robots_present"), F.concat(F.lit("All "), "bots", F.lit(" configured bots are allowed."))).otherwise("No robots.txt; all configured bots are allowed by default.")
    kind = {"ignore": "pass", "report": "warn"}.get(policy, "fail")
    return decide(crawl.sites, agg, "ACC-001", [(F.col("parse_failed"), "warn", "robots.txt could not be parsed; treated as no rules"), (F.col("n_blocked") == 0, "pass", free), (None, kind, some)], ["robots_present", "n_blocked", "blocked", "by_purpose"], "robots.txt was not fetched")


def parity_rows(crawl: Crawl) -> DataFrame:
    """Each bot's fetch of a page beside the browser's, where that was fine: status, bytes,
    similarity of the main texts, and whether they diverge.

    Equal bodies have equal texts, so words are compared only for distinct pairs of bodies that
    differ; rows carry hashes."""
    keys = list(PAGE)
    rows = crawl.fetches.where("lens <> 'rendered'")
    base = rows.where((F.col("lens") == "browser") & ok()).select(*keys, F.col("status").alias("browser_status"), F.col("bytes").alias("browser_bytes"), F.col("sha").alias("a"))
    bots = rows.where("lens <> 'browser'").select(*keys, F.col("lens").alias("bot"), F.col("status").alias("bot_status"), F.col("bytes").alias("bot_bytes"), F.col("error").alias("bot_error"), F.col("blocked_by").alias("bot_blocked_by"), F.coalesce("sha", F.lit("")).alias("b"))
    rows = base.withColumn("a", F.coalesce("a", F.lit(""))).join(bots, keys)
    words = crawl.bodies.select("sha", text.tokens(F.col("text")).alias("words"))
    pairs = rows.select("a", "b").distinct()
    pairs = pairs.join(words.toDF("a", "wa"), "a", "left").join(words.toDF("b", "wb"), "b", "left")
    none = F.array().cast("array<string>")
    wa, wb = F.coalesce("wa", none), F.coalesce("wb", none)
    alike = F.when((F.size(wa) > 0) | (F.size(wb) > 0), F.when(F.col("a") == F.col("b"), 1.0).otherwise(numbers.rounded(text.jaccard(wa, wb), 4)))
    rows = rows.join(pairs.select("a", "b", alike.alias("similarity")), ["a", "b"], "left").drop("a", "b")
    rows = rows.withColumn("status_match", F.col("browser_status").eqNullSafe(F.col("bot_status"))).withColumn("size_ratio", numbers.share(F.col("bot_bytes"), F.col("browser_bytes")))
    far = ~F.col("status_match") | (F.col("bot_error").isNotNull() & F.coalesce(F.col("bot_blocked_by").isin("waf", "challenge"), F.lit(False))) | F.coalesce(F.col("similarity") < fixed.PARITY_SIMILARITY, F.lit(False)) | (F.col("bot_bytes") == 0)
    return rows.withColumn("diverged", far)


def parity(crawl: Crawl) -> DataFrame:
    """ACC-002. Two aggregations: a share for each bot, then the largest."""
    by_bot = parity_rows(crawl).groupBy("site_id", "bot").agg(F.count(F.lit(1)).alias("pages"), _count(F.col("diverged")).alias("diverged"))
    by_bot = by_bot.withColumn("share", numbers.share(F.col("diverged"), F.col("pages")))
    agg = by_bot.groupBy("site_id").agg(F.sum("pages").alias("compared"), F.array_sort(F.collect_list(F.when(F.col("share") > fixed.MINORITY, F.col("bot")))).alias("majority"), F.array_sort(F.collect_list(F.when(F.col("diverged") > 0, F.col("bot")))).alias("minority"), F.max("share").alias("worst"), F.array_sort(F.collect_list(F.struct("bot", "diverged", "pages", "share"))).alias("bots"))
    return decide(crawl.sites, agg, "ACC-002", [
        (F.col("worst") > fixed.MINORITY, "fail", F.concat(_names(F.col("majority")), F.lit(" receive different content than a browser on a majority of pages."))),
        (F.col("worst") > 0, "warn", F.concat(_names(F.col("minority")), F.lit(" differ from the browser view on a minority of pages."))),
        (None, "pass", "All bots receive the same content as a browser."),
    ], ["compared", "bots"], "no page returned a successful browser fetch to compare against")


def blocks(crawl: Crawl, policy: str = "report") -> DataFrame:
    """ACC-003. Sites without any response pass, as nothing blocked was seen."""
    rows = crawl.fetches.where(F.col("error").isNotNull() | F.col("status").isNotNull()).join(crawl.sites.select("site_id", "start_url"), "site_id")
    bad = F.coalesce(F.col("blocked_by").isin("waf", "challenge"), F.lit(False)) | F.coalesce(F.col("status") >= 400, F.lit(False))
    agg = rows.groupBy("site_id").agg(F.count(F.lit(1)).alias("total"), _count(bad).alias("blocked"), F.bool_or(bad & (F.col("url") == F.col("start_url")) & (F.col("lens") == "browser")).alias("start_blocked"))
    rank = F.row_number().over(Window.partitionBy("site_id").orderBy("pos", "lens", "url"))  # a group limit before the shuffle
    first = rows.where(bad).select("site_id", "pos", "lens", "url", "status", "blocked_by", rank.alias("rank")).where(F.col("rank") <= 20)
    first = first.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("pos", "lens", "url", "status", "blocked_by"))).alias("details"))
    agg = crawl.sites.select("site_id").join(agg, "site_id", "left").join(first, "site_id", "left").na.fill({"total": 0, "blocked": 0, "start_blocked": False})
    counted = F.concat("blocked", F.lit(" of "), "total", F.lit(" responses were blocked or challenged."))
    share = F.col("blocked") / F.greatest(F.col("total"), F.lit(1))
    return decide(crawl.sites, agg, "ACC-003", [
        (F.col("blocked") == 0, "pass", "No blocking status or challenge page observed."),
        (F.col("start_blocked") & F.lit(policy != "ignore"), "fail", "The start URL is blocked."),
        ((share > fixed.MINORITY) & F.lit(policy == "fail"), "fail", counted),
        (None, "warn", counted),
    ], ["total", "blocked", "start_blocked", "details"])


# Rendering


def nojs_text(crawl: Crawl) -> DataFrame:
    """REN-001: text without JavaScript against rendered text, or shell heuristics where none was rendered."""
    nojs = crawl.views.where("lens = 'browser-nojs'")
    rendered = crawl.views.where("lens = 'rendered'").select(*PAGE, F.col("text_chars").alias("rendered_chars"))
    rows = nojs.join(rendered, list(PAGE), "left").na.fill({"rendered_chars": 0})
    rows = rows.withColumn("ratio", numbers.share(F.col("text_chars"), F.col("rendered_chars")))
    far = F.col("rendered_chars") >= fixed.REN_RENDER_CHARS
    agg = rows.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("pages"), F.bool_or(F.col("rendered_chars") > 0).alias("compared"), _count(far).alias("usable"), F.avg(F.when(far, F.col("ratio"))).alias("mean_ratio"),
        F.min_by(F.when(far, F.col("url")), F.when(far, F.struct("ratio", "pos"))).alias("worst_page"), _count(F.col("text_chars") < fixed.REN_LOW_CHARS).alias("empty"), _count(F.col("text_chars") < fixed.REN_PASS_CHARS).alias("small"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("shell_markers")))).alias("shells"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("framework_markers")))).alias("frameworks"),
    )
    m, shells = F.col("mean_ratio"), F.size("shells") > 0
    share = F.concat(F.round(m * 100).cast("int"), F.lit("% of page text is available without JavaScript."))
    return decide(crawl.sites, agg, "REN-001", [
        (F.col("compared") & (F.col("usable") == 0), "skip", "rendered text was too short on every page to compare"),
        (F.col("compared") & (m >= fixed.REN_PASS), "pass", share), (F.col("compared") & (m >= fixed.REN_FAIL), "warn", share), (F.col("compared"), "fail", share),
        ((F.col("empty") > 0) & shells, "fail", "Main content is empty without JavaScript, with app-shell markers present."),
        (shells, "warn", "App-shell markers present; not measured without rendering.", "low"),
        (F.col("small") > 0, "warn", "Some pages yield little main text before JavaScript.", "medium"),
        (None, "pass", "Every sampled page yields enough main text without JavaScript.", "medium"),
    ], ["pages", "compared", "mean_ratio", "worst_page", "empty", "small", "shells", "frameworks"])


def extractable(crawl: Crawl) -> DataFrame:
    """REN-002: how much main text could be extracted."""
    n, views = F.col("text_chars"), crawl.views.where("lens = 'browser-nojs'")
    # the upper median from counts of each length: no site's lengths are gathered
    site = Window.partitionBy("site_id")
    hist = views.groupBy("site_id", "text_chars").agg(F.count(F.lit(1)).alias("k"))
    hist = hist.select("site_id", "text_chars", F.sum("k").over(site.orderBy("text_chars")).alias("upto"), F.sum("k").over(site).alias("all"))
    middle = hist.where(F.col("upto") > F.floor(F.col("all") / 2)).groupBy("site_id").agg(F.min("text_chars").alias("median_chars"))
    agg = views.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("pages"), _count(n < fixed.EXTRACT_FAIL).alias("thin"), _count((n >= fixed.EXTRACT_FAIL) & (n < fixed.EXTRACT_PASS)).alias("weak"),
        _count((F.col("html_chars") > fixed.EXTRACT_LARGE) & (F.col("extraction_ratio") < fixed.EXTRACT_LOW_RATIO)).alias("boilerplate"), F.array_sort(F.collect_set("extraction_mode")).alias("modes"),
    ).join(middle, "site_id")
    return decide(crawl.sites, agg, "REN-002", [(F.col("thin") > 0, "fail", "Extraction yielded almost no text on some pages."), ((F.col("weak") > 0) | (F.col("boilerplate") > 0), "warn", "Thin extraction on some pages."), (None, "pass", "Main content extracts cleanly.")], ["pages", "thin", "weak", "boilerplate", "median_chars", "modes"])


# Discovery


def sitemap_check(crawl: Crawl) -> DataFrame:
    """DIS-001."""
    agg = crawl.sitemap.withColumnRenamed("found", "found_")
    return decide(crawl.sites, agg, "DIS-001", [(~F.col("found_"), "fail", "No sitemap found."), ((F.col("parse_errors") > 0) | ~F.col("includes_start_url"), "warn", "Sitemap found, with problems or without the start URL."), (None, "pass", "Sitemap found, including the start URL.")], ["found_", "url_count", "parse_errors", "includes_start_url", "stale"], "no sitemap was discovered")


def indexing(crawl: Crawl) -> DataFrame:
    """DIS-002: robots meta directives against the sitemap. The first page is the one of least pos."""
    low = F.lower(F.coalesce("robots_meta", F.lit("")))
    found = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(d)), F.lit(d)) for d in fixed.INDEX_DIRECTIVES)))
    listed = crawl.entries.join(crawl.sites.select("site_id", "start_url"), "site_id").where(urls.same_origin(F.col("loc"), F.col("start_url"))).select("site_id", F.col("loc").alias("url"), F.lit(True).alias("in_sitemap")).distinct()
    rows = crawl.structure.select("site_id", "url", "pos", found.alias("directives")).join(listed, ["site_id", "url"], "left")
    some = F.size("directives") > 0
    agg = rows.groupBy("site_id").agg(F.count(F.lit(1)).alias("pages"), F.min_by("directives", "pos").alias("first"), _count(some).alias("marked"), _count(some & F.col("in_sitemap")).alias("contradictions"))
    return decide(crawl.sites, agg, "DIS-002", [
        (F.array_contains("first", "noindex"), "fail", "The start URL carries a noindex directive."), (F.col("contradictions") > 0, "warn", "Pages are listed in the sitemap but declare directives against it."),
        (F.col("marked") == 0, "pass", "No conflicting indexing directives found."), (None, "warn", "Pages declare indexing directives."),
    ], ["pages", "marked", "contradictions"])


def llms_txt(crawl: Crawl) -> DataFrame:
    """DIS-003: presence and shape of /llms.txt."""
    lines = F.split(F.coalesce("body", F.lit("")), r"\R")
    rows = crawl.llms.select("site_id", "status", "error", F.exists(lines, lambda x: x.startswith("# ")).alias("has_h1"), F.size(F.filter(lines, lambda x: F.contains(x, F.lit("](")))).alias("links"), F.exists(lines, lambda x: (F.trim(x) != "") & ~F.substring(x, 1, 1).isin("#", "-", "[")).alias("has_summary"))
    gone = (F.col("status") == 404) | (F.col("error").isNotNull() & F.col("status").isNull())
    return decide(crawl.sites, rows, "DIS-003", [(gone, "fail", "/llms.txt is not present."), (~ok(), "warn", "/llms.txt returned an error."), (~F.col("has_h1") | (F.col("links") == 0) | ~F.col("has_summary"), "warn", "/llms.txt exists but is malformed."), (None, "pass", "/llms.txt is present and well-formed.")], ["status", "has_h1", "links", "has_summary"], "/llms.txt was not fetched")


# Structure


def titles(crawl: Crawl) -> DataFrame:
    """STR-001. The check passes the whole start URL for the path, so no page is exempt as the home page."""
    lo, hi = fixed.TITLE_RANGE
    t, n = F.coalesce("title", F.lit("")), F.length(F.coalesce("title", F.lit("")))
    by_title = crawl.structure.groupBy("site_id", t.alias("t")).agg(F.count(F.lit(1)).alias("k"), _count((t != "") & ~n.between(lo, hi)).alias("out"), _count(H.generic_title(F.nullif(t, F.lit("")), F.lit("url"))).alias("generic"))
    agg = by_title.groupBy("site_id").agg(F.sum("k").alias("pages"), F.coalesce(F.sum(F.when(F.col("t") == "", F.col("k"))), F.lit(0)).alias("missing"), F.sum("out").alias("out_of_range"), F.sum("generic").alias("generic"), _count((F.col("t") != "") & (F.col("k") > 1)).alias("duplicates"))
    odd = F.col("missing") + F.col("out_of_range") + F.col("generic") + F.col("duplicates") > 0
    return decide(crawl.sites, agg, "STR-001", [(F.col("missing") == F.col("pages"), "fail", "No page has a <title>."), (odd, "warn", "Titles need work."), (None, "pass", "Every sampled page has a specific title.")], ["pages", "missing", "out_of_range", "generic", "duplicates"])


def descriptions(crawl: Crawl) -> DataFrame:
    """STR-002."""
    n = F.length(F.coalesce("description", F.lit("")))
    agg = crawl.structure.groupBy("site_id").agg(F.count(F.lit(1)).alias("pages"), _count(n == 0).alias("missing"), _count((n > 0) & ~n.between(*fixed.DESCRIPTION_RANGE)).alias("out_of_range"))
    return decide(crawl.sites, agg, "STR-002", [(F.col("missing") == F.col("pages"), "fail", "No page has a meta description."), ((F.col("missing") > 0) | (F.col("out_of_range") > 0), "warn", "Meta descriptions need work."), (None, "pass", "Every sampled page has a description.")], ["pages", "missing", "out_of_range"])


def canonical(crawl: Crawl) -> DataFrame:
    """STR-003."""
    c = F.coalesce("canonical", F.lit(""))
    odd = (c != "") & ((urls.bare(c) != urls.bare(F.col("url"))) | ~c.rlike("^https?://") | (F.col("canonical_count") != 1))
    agg = crawl.structure.groupBy("site_id").agg(F.count(F.lit(1)).alias("pages"), _count(c == "").alias("absent"), _count(odd).alias("odd"))
    return decide(crawl.sites, agg, "STR-003", [(F.col("absent") == F.col("pages"), "fail", "No page declares a canonical URL."), ((F.col("absent") > 0) | (F.col("odd") > 0), "warn", "Canonical URLs need work."), (None, "pass", "Every sampled page has a self-referencing canonical URL.")], ["pages", "absent", "odd"])


def _levels(level: int):
    return F.filter("headings", lambda h: h["level"] == level)


def one_h1(crawl: Crawl) -> DataFrame:
    """STR-004. Pages without an H1 count only if no page has one."""
    n = F.size(_levels(1))
    empty = (n > 0) & ~F.exists(_levels(1), lambda h: h["text"] != "")
    agg = crawl.structure.groupBy("site_id").agg(F.count(F.lit(1)).alias("pages"), _count(n == 0).alias("none"), _count(n > 1).alias("multiple"), _count(empty).alias("empty"))
    return decide(crawl.sites, agg, "STR-004", [(F.col("none") == F.col("pages"), "fail", "No page has an H1."), ((F.col("multiple") > 0) | (F.col("empty") > 0), "warn", "H1 headings need work."), (None, "pass", "Pages have exactly one H1.")], ["pages", "none", "multiple", "empty"])


def hierarchy(crawl: Crawl) -> DataFrame:
    """STR-005. Headings are in order of level, so skips are gaps in the levels that are used."""
    some, empty, skipped = F.size(F.filter("headings", lambda h: h["text"] != "")), F.size(F.filter("headings", lambda h: h["text"] == "")), F.size("skipped")
    bad = (skipped > 0) | (empty > 0)
    worse = bad & ((F.size(_levels(1)) > 1) | (skipped > 1) | (empty > 1))
    agg = crawl.structure.groupBy("site_id").agg(F.count(F.lit(1)).alias("pages"), _count(some == 0).alias("without"), _count(bad).alias("bad"), _count(worse).alias("worse"))
    return decide(crawl.sites, agg, "STR-005", [(F.col("without") == F.col("pages"), "fail", "No page has headings."), (F.col("worse") > 0, "fail", "Pages combine several heading faults."), (F.col("bad") > 0, "warn", "Pages skip a heading level or have an empty heading."), (None, "pass", "Heading levels are in order.")], ["pages", "without", "bad", "worse"])


def lang(crawl: Crawl) -> DataFrame:
    """STR-006."""
    v = F.coalesce("lang", F.lit(""))
    agg = crawl.structure.groupBy("site_id").agg(F.count(F.lit(1)).alias("pages"), _count(v == "").alias("absent"), _count((v != "") & ~H.valid_lang(v)).alias("invalid"))
    return decide(crawl.sites, agg, "STR-006", [(F.col("absent") == F.col("pages"), "fail", "No page declares a language."), ((F.col("absent") > 0) | (F.col("invalid") > 0), "warn", "lang attributes need work."), (None, "pass", "Every sampled page declares a valid language.")], ["pages", "absent", "invalid"])


# Structured data


def json_ld(crawl: Crawl) -> DataFrame:
    """SD-001."""
    agg = crawl.structure.groupBy("site_id").agg(F.count(F.lit(1)).alias("pages"), _count(F.col("ld.blocks") == 0).alias("without"), _count((F.col("ld.blocks") > 0) & (F.col("ld.parsed") == 0)).alias("unparsed"), _count((F.col("ld.parsed") > 0) & (F.size("ld.types") == 0)).alias("untyped"))
    return decide(crawl.sites, agg, "SD-001", [(F.col("without") == F.col("pages"), "fail", "No page has a JSON-LD block."), ((F.col("unparsed") > 0) | (F.col("untyped") > 0), "warn", "JSON-LD needs work."), (None, "pass", "JSON-LD parses and declares types.")], ["pages", "without", "unparsed", "untyped"])


def entity_types(types):
    """Types that are entities, not containers; each once."""
    return F.array_distinct(F.array_except(types, F.array(*map(F.lit, fixed.CONTAINER_TYPES))))


def role_rows(crawl: Crawl) -> DataFrame:
    """Role of each page, the types it has and those its role would have that are missing."""
    rows = crawl.structure.select("site_id", "url", "pos", "path", "title", entity_types(F.col("ld.types")).alias("types"))
    rows = rows.withColumn("role", urls.role(F.col("path"), F.col("title"), F.col("types")))
    return rows.withColumn("missing", F.array_sort(F.array_except(urls.expected_types(F.col("role")), F.col("types"))))


def types_for_role(crawl: Crawl) -> DataFrame:
    """SD-002. All types that the role would have are asked for."""
    rows = role_rows(crawl).join(crawl.sites.select("site_id", "start_url"), "site_id")
    no_org = (F.col("url") == F.col("start_url")) & urls.is_home(F.col("path")) & ~F.array_contains("types", fixed.HOME_MANDATORY)
    agg = rows.groupBy("site_id").agg(F.count(F.lit(1)).alias("pages"), _count(F.size("types") == 0).alias("without"), F.bool_or(no_org).alias("home_without_organization"), _count(F.size("missing") > 0).alias("mismatched"))
    return decide(crawl.sites, agg, "SD-002", [(F.col("without") == F.col("pages"), "fail", "No page declares any structured data entity type."), (F.col("home_without_organization"), "fail", "No Organization JSON-LD on the home page."), (F.col("mismatched") > 0, "warn", "JSON-LD does not match the role of some pages."), (None, "pass", "Structured data types match the roles of the pages.")], ["pages", "without", "home_without_organization", "mismatched"])


def open_graph(crawl: Crawl) -> DataFrame:
    """SD-003: for each page the first tag that is missing."""
    has = {t: F.coalesce(F.try_element_at("og", F.lit(t)), F.lit("")) != "" for t in fixed.OG_TAGS}
    home = urls.is_home(F.col("path"))
    problem = F.when(~has["og:title"], "title").when(~has["og:description"], "description").when(home & ~(has["og:url"] & has["og:image"]), "home").when(~home & ~has["og:image"], "image")
    none = ~(has["og:title"] | has["og:description"] | has["og:url"] | has["og:image"])
    agg = crawl.structure.groupBy("site_id").agg(F.count(F.lit(1)).alias("pages"), _count(none).alias("without"), F.count(problem).alias("problems"))
    return decide(crawl.sites, agg, "SD-003", [(F.col("without") == F.col("pages"), "fail", "No page declares Open Graph tags."), (F.col("problems") > 0, "warn", "Open Graph is incomplete."), (None, "pass", "Open Graph tags are complete.")], ["pages", "without", "problems"])


# Trust


def date_rows(crawl: Crawl) -> DataFrame:
    """Every machine-readable date of a page: source and value."""
    base = crawl.structure
    meta = base.select(*PAGE, F.explode(F.array(*(F.struct(F.lit(f"meta:{k}").alias("source"), F.try_element_at("meta_tags", F.lit(k)).alias("value")) for k in fixed.META_DATES))).alias("d"))
    time = base.select(*PAGE, F.explode(F.transform("time_datetimes", lambda v: F.struct(F.lit("time[datetime]").alias("source"), v.alias("value")))).alias("d"))
    item = base.select(*PAGE, F.explode("ld.items").alias("item"))
    ld = item.select(*PAGE, F.explode(F.array(*(F.struct(F.lit(f"jsonld:{k}").alias("source"), text_at(F.col("item"), k).alias("value")) for k in fixed.JSONLD_DATES))).alias("d"))
    return meta.unionByName(time).unionByName(ld).where("coalesce(d.value, '') <> ''").select(*PAGE, "d.source", "d.value")


def page_dates(crawl: Crawl) -> DataFrame:
    bad = dates.parse_date(F.col("value")).isNull()
    found = date_rows(crawl).groupBy(*PAGE).agg(F.count(F.lit(1)).alias("dates"), _count(bad).alias("unparseable"))
    prose = crawl.structure.select(*PAGE, F.coalesce("body_text", F.lit("")).rlike(fixed.PROSE_DATE).alias("prose"))
    return prose.join(found, list(PAGE), "left").na.fill({"dates": 0, "unparseable": 0})


def publish_dates(crawl: Crawl) -> DataFrame:
    """TRU-001. Once some page has a date the check warns, whatever the others have."""
    agg = page_dates(crawl).groupBy("site_id").agg(F.count(F.lit(1)).alias("pages"), _count((F.col("dates") == 0) & ~F.col("prose")).alias("undated"), _count(F.col("unparseable") > 0).alias("unparseable"))
    return decide(crawl.sites, agg, "TRU-001", [(F.col("undated") == F.col("pages"), "fail", "No machine-readable publish or modified date was found."), (None, "warn", "Dates need work.")], ["pages", "undated", "unparseable"])


def author_rows(crawl: Crawl) -> DataFrame:
    """Source and value of the first signal of an author or organisation on each page."""
    item = crawl.structure.select(*PAGE, F.posexplode("ld.items").alias("i", "item"))

    def signals():
        for rank, key in enumerate(fixed.AUTHOR_KEYS):
            first = F.get_json_object("item", f"$.{key}[0]")
            inner = F.coalesce(text_at(F.col("item"), key), text_at(F.to_json(F.array(first)), "x"))
            yield F.struct(F.lit(rank).alias("rank"), F.lit(f"jsonld:{key}").alias("source"), F.trim(inner).alias("value"))
            name = F.coalesce(F.get_json_object("item", f"$.{key}.name"), F.get_json_object("item", f"$.{key}[0].name"))
            yield F.struct(F.lit(rank).alias("rank"), F.lit(f"jsonld:{key}.name").alias("source"), F.trim(name).alias("value"))
        for rank, key in ((10, "name"), (11, "legalName")):
            yield F.struct(F.lit(rank).alias("rank"), F.lit("jsonld:name").alias("source"), F.trim(text_at(F.col("item"), key)).alias("value"))

    found = item.select(*PAGE, "i", F.explode(F.array(*signals())).alias("s")).where("coalesce(s.value, '') <> ''")
    late = F.col("s.rank") >= 10
    best = found.groupBy(*PAGE).agg(F.min_by(F.struct("s.source", "s.value"), F.struct(late, F.col("i"), F.col("s.rank"))).alias("ld"))
    heads = F.filter("headings", lambda h: (h["level"] <= 2) & F.contains(F.lower(h["text"]), F.lit("author")))
    rows = crawl.structure.select(*PAGE, F.nullif(F.try_element_at("og", F.lit("og:site_name")), F.lit("")).alias("site_name"), F.try_element_at(heads, F.lit(1))["text"].alias("head")).join(best, list(PAGE), "left")
    return rows.select(*PAGE, F.coalesce("ld.source", F.when(F.col("site_name").isNotNull(), "meta:og:site_name"), F.when(F.col("head").isNotNull(), "visible:heading")).alias("source"), F.coalesce("ld.value", "site_name", "head").alias("value"))


def authors(crawl: Crawl) -> DataFrame:
    """TRU-002."""
    agg = author_rows(crawl).groupBy("site_id").agg(F.count(F.lit(1)).alias("pages"), _count(F.col("source").isNull()).alias("unnamed"), _count(F.col("source") == "jsonld:publisher").alias("publisher_only"))
    return decide(crawl.sites, agg, "TRU-002", [(F.col("unnamed") == F.col("pages"), "fail", "No author or organization signal was found."), (F.col("publisher_only") > 0, "warn", "An organization is named but no author."), (None, "pass", "An author or organization is identifiable.")], ["pages", "unnamed", "publisher_only"])


# Site


def max_age(hsts):
    return F.regexp_extract(F.lower(hsts), r"(?:^|;)\s*max-age=(\d+)\s*(?:;|$)", 1).try_cast("long")


def transport(crawl: Crawl) -> DataFrame:
    """SITE-001: HTTPS, HSTS and redirects of the start URL's browser fetch."""
    rows = crawl.fetches.where("lens = 'browser'").join(crawl.sites.select("site_id", "start_url"), "site_id").where("url = start_url")
    hops = F.coalesce(F.size("redirect_chain"), F.lit(0))
    pairs = F.transform("redirect_chain", lambda h: F.struct(h["from"].alias("a"), h["to"].alias("b")))
    rows = rows.withColumn("first", F.row_number().over(Window.partitionBy("site_id").orderBy("pos"))).where("first = 1")
    hsts = F.nullif(F.try_element_at("headers", F.lit("strict-transport-security")), F.lit(""))
    agg = rows.select("site_id", "status", "error", "final_url", hops.alias("hops"), F.coalesce(F.size(F.array_distinct(pairs)) < hops, F.lit(False)).alias("loop"), hsts.alias("hsts"), max_age(hsts).alias("hsts_max_age"), (urls.scheme(F.col("final_url")) == "https").alias("https"))
    return decide(crawl.sites, agg, "SITE-001", [
        (F.col("error").isNotNull() & F.col("status").isNull(), "error", "Could not fetch the start URL."), (~F.col("https"), "fail", "The site is not served over HTTPS."), (F.col("loop"), "fail", "The redirect chain loops."),
        (F.col("hsts").isNull(), "warn", "HTTPS, but no Strict-Transport-Security header."), (F.col("hops") > 1, "warn", "HTTPS with HSTS, but a long redirect chain."), (None, "pass", "HTTPS with HSTS."),
    ], ["final_url", "hops", "loop", "hsts", "hsts_max_age"], "the start URL was not fetched")


CHECKS = {
    "ACC-002": parity, "ACC-001": robots_rules, "ACC-003": blocks, "REN-001": nojs_text, "REN-002": extractable, "DIS-001": sitemap_check, "STR-001": titles, "STR-002": descriptions,
    "STR-003": canonical, "STR-004": one_h1, "STR-005": hierarchy, "STR-006": lang, "SD-001": json_ld, "SD-002": types_for_role, "SD-003": open_graph, "DIS-002": indexing, "DIS-003": llms_txt,
    "TRU-001": publish_dates, "TRU-002": authors, "SITE-001": transport,
}
