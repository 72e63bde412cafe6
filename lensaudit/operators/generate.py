"""Generated artifacts: llms.txt, robots.txt and JSON-LD skeletons."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text, urls
from ..sources.crawl import PAGE


def page_entries(views: DataFrame, structure: DataFrame, sites: DataFrame) -> DataFrame:
    """Pages with text: site_id, url, pos, label, is_start and section (first path segment)."""
    seen = views.where("lens = 'browser-nojs'").where(F.trim("text") != "").select(*PAGE)
    rows = structure.join(seen, list(PAGE), "left_semi").join(sites.select("site_id", "start_url"), "site_id")
    label = F.coalesce(F.nullif(F.trim(F.coalesce("title", F.lit(""))), F.lit("")), F.col("url"))
    return rows.select(*PAGE, label.alias("label"), (urls.bare(F.col("url")) == urls.bare(F.col("start_url"))).alias("is_start"), urls.segment(F.col("url")).alias("section"))


def sections(entries: DataFrame) -> DataFrame:
    """Sections in their order: the overview of start pages, the root, then by name."""
    rank = F.when(F.col("is_start"), 0).when(F.col("section") == "", 1).otherwise(2)
    name = F.when(F.col("is_start"), "Overview").when(F.col("section") == "", "Other").otherwise(text.title_case(F.regexp_replace("section", "[-_]", " ")))
    line = F.concat(F.lit("- ["), "label", F.lit("]("), "url", F.lit(")"))
    key = F.when(F.col("is_start"), "").otherwise(F.col("section"))
    rows = entries.select("site_id", rank.alias("rank"), key.alias("section"), name.alias("heading"), "pos", line.alias("line"))
    grouped = rows.groupBy("site_id", "rank", "section", "heading").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("ls"))
    order = F.row_number().over(Window.partitionBy("site_id").orderBy("rank", "section"))
    return grouped.select("site_id", order.alias("ord"), "heading", F.size("ls").alias("pages"), F.concat_ws("\n", F.transform("ls", lambda x: x["line"])).alias("links"))


def llms_txt(sites: DataFrame, entries: DataFrame) -> DataFrame:
    """One document for each site; without pages it says so."""
    blocks = sections(entries).select("site_id", F.struct("ord", F.concat(F.lit("## "), "heading", F.lit("\n\n"), "links", F.lit("\n")).alias("b")).alias("s"))
    body = blocks.groupBy("site_id").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list("s")), lambda x: x["b"])).alias("body"))
    host = urls.netloc(F.col("start_url"))
    head = F.concat(F.lit("# "), host, F.lit("\n\n> Facts and documentation about "), host, F.lit(".\n\n"))
    return sites.join(body, "site_id", "left").select("site_id", F.concat(head, F.coalesce("body", F.lit("## Pages\n\n(none found)\n"))).alias("content"))


def agents(policy: str) -> list[str]:
    """Agents that a policy denies by name, in the order of the file."""
    if policy not in fixed.ROBOT_POLICIES:
        raise ValueError(f"unknown policy {policy!r}; choose from {', '.join(fixed.ROBOT_POLICIES)}")
    if policy == "allow-search-block-training":
        return list(fixed.TRAINING_AGENTS)
    return sorted({*fixed.TRAINING_AGENTS, *fixed.SEARCH_AGENTS, *fixed.OTHER_AGENTS}) if policy == "block-all-ai" else []


def robots_txt(sites: DataFrame, policy: str = "allow-search-block-training", sitemaps: DataFrame | None = None, crawl_delay: int | None = None) -> DataFrame:
    """A robots.txt for each site from a policy, its sitemaps (site_id, pos, url) named at the end."""
    rule = "Disallow: /" if policy == "block-all-ai" else "Allow: /"
    text = f"# Preset: {policy}. Review before publishing.\nUser-agent: *\n{rule}\n" + "".join(f"\nUser-agent: {a}\nDisallow: /\n" for a in agents(policy))
    text += f"\nCrawl-delay: {crawl_delay}\n" if crawl_delay else ""
    head = F.concat(F.lit("# robots.txt for "), urls.netloc(F.col("start_url")), F.lit("\n"), F.lit(text))
    if sitemaps is None:
        return sites.select("site_id", head.alias("content"))
    lines = sitemaps.groupBy("site_id").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("pos", "url"))), lambda x: F.concat(F.lit("\nSitemap: "), x["url"]))).alias("maps"))
    return sites.join(lines, "site_id", "left").select("site_id", F.concat(head, F.coalesce(F.concat("maps", F.lit("\n")), F.lit(""))).alias("content"))


def json_ld(spark: SparkSession, kind: str, sites: DataFrame) -> DataFrame:
    """A skeleton for each site (site_id, start_url, title, description): observed fields, and a
    list of those left to fill in."""
    if kind not in fixed.JSONLD_SKELETONS:
        raise ValueError(f"unknown type {kind!r}; choose from {', '.join(fixed.JSONLD_SKELETONS)}")
    spec = fixed.JSONLD_SKELETONS[kind]
    text = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    seen = {"name": text("title"), "headline": text("title"), "description": text("description"), "url": F.col("start_url")}
    fields = [(f, seen[f]) for f in (*spec["required"], *spec["optional"]) if f in seen]
    todo = F.array_compact(F.array(*(F.when(seen[f].isNull() if f in seen else F.lit(True), F.lit(f)) for f in spec["required"])))
    doc = F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit(kind).alias("@type"), *(c.alias(f) for f, c in fields), F.struct(todo.alias("required"), F.lit(json.dumps([f for f in spec["optional"] if f not in seen])).alias("optional")).alias("_todo")))
    return sites.select("site_id", doc.alias("content"), todo.alias("missing"))
