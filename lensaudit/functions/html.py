"""HTML expressions over raw pages, for stages that stay in whole-stage codegen.

They read well-formed and mildly broken pages. ``sources.html_parser`` reads any page by
a tolerant parser and yields the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .text import names_of, squeeze, strip

NOISE = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
LD_BLOCK = r"""(?is)<script\b[^>]*type\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script>"""


def unescape(c: Column) -> Column:
    for code, char in ENTITIES:
        c = F.replace(c, F.lit(code), F.lit(char))
    return c


def clean(html: Column) -> Column:
    """Without comments, scripts and styles."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), NOISE, "")


def inner_text(fragment: Column) -> Column:
    """Text of a fragment: each text between tags is stripped, and they are joined."""
    return F.trim(unescape(F.regexp_replace(F.regexp_replace(fragment, r"\s*<[^>]*>\s*", ""), r"^\s+|\s+$", "")))


def title(html: Column) -> Column:
    """Text of the first title; null without one."""
    c = clean(html)
    return F.when(c.rlike(r"(?is)<title[^>]*>.*?</title>"), inner_text(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a tag, quoted or not; null without it."""
    pattern = rf"""(?is)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.when(tag.rlike(pattern), unescape(F.concat(*(F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)))))


def first_tag(html: Column, pattern: str) -> Column:
    return F.regexp_extract(clean(html), pattern, 0)


def lang(html: Column) -> Column:
    return attribute(first_tag(html, r"(?is)<html\b[^>]*>"), "lang")


def canonicals(html: Column) -> Column:
    """All canonical link tags."""
    return F.regexp_extract_all(clean(html), F.lit(r"""(?is)<link\b[^>]*\brel\s*=\s*(?:"canonical"|'canonical'|canonical(?=[\s>/]))[^>]*>"""), F.lit(0))


def meta_tags(html: Column) -> Column:
    """Map of name or property to stripped content of the meta tags that have both; the last wins."""
    tags = F.regexp_extract_all(clean(html), F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))

    def entry(t):
        key = F.coalesce(F.nullif(attribute(t, "name"), F.lit("")), attribute(t, "property"), F.lit(""))
        return F.struct(key.alias("key"), strip(F.coalesce(attribute(t, "content"), F.lit(""))).alias("value"))

    pairs = F.filter(F.transform(tags, entry), lambda e: (e["key"] != "") & (e["value"] != ""))
    # the last of a key wins: keep those that no later entry repeats
    keys = F.transform(pairs, lambda e: e["key"])
    n = F.size(pairs)
    last = F.filter(pairs, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.greatest(n, F.lit(1))), e["key"]))
    return F.map_from_entries(last)


def headings(html: Column) -> Column:
    """Array of (level, text), all of level 1 first, then level 2, and so on."""
    c = clean(html)

    def of(level: int) -> Column:
        found = F.regexp_extract_all(c, F.lit(rf"(?is)<h{level}(?:\s[^>]*)?>(.*?)</h{level}>"), F.lit(1))
        return F.transform(found, lambda t: F.struct(F.lit(level).alias("level"), inner_text(t).alias("text")))

    return F.concat(*(of(i) for i in range(1, 7)))


def skipped_levels(heads: Column) -> Column:
    """(from, to) of neighbours in the outline of non-empty headings that skip a level."""
    levels = F.transform(F.filter(heads, lambda h: h["text"] != ""), lambda h: h["level"])
    n = F.greatest(F.size(levels) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(levels, 1, n), F.slice(levels, 2, n), lambda a, b: F.struct(a.alias("from"), b.alias("to")))
    return F.filter(pairs, lambda p: p["to"] > p["from"] + 1)


def time_datetimes(html: Column) -> Column:
    tags = F.regexp_extract_all(clean(html), F.lit(r"(?is)<time\b[^>]*>"), F.lit(0))
    return F.filter(F.transform(tags, lambda t: F.trim(F.coalesce(attribute(t, "datetime"), F.lit("")))), lambda v: v != "")


def has_main(html: Column) -> Column:
    return clean(html).rlike(r"""(?is)<main\b|<div\b[^>]*\brole\s*=\s*["']main["']""")


def body_text(html: Column) -> Column:
    c = clean(html)
    inner = F.when(c.rlike(r"(?is)<body\b[^>]*>"), F.regexp_extract(c, r"(?is)<body\b[^>]*>(.*)", 1)).otherwise(c)
    return squeeze(unescape(F.regexp_replace(inner, r"<[^>]*>", " ")))


def framework_markers(html: Column) -> Column:
    return names_of(html, fixed.FRAMEWORK_MARKERS)


def shell_markers(html: Column) -> Column:
    return names_of(html, fixed.SHELL_MARKERS)


def looks_like_shell(framework: Column, shell: Column, chars: Column) -> Column:
    return (F.size(shell) > 0) | ((F.size(framework) > 0) & (chars < fixed.RECALL_FLOOR))


def ld_blocks(html: Column) -> Column:
    """Raw JSON-LD blocks."""
    c = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", "")
    return F.regexp_extract_all(c, F.lit(LD_BLOCK), F.lit(1))


def valid_lang(c: Column) -> Column:
    return F.coalesce(c.rlike(fixed.LANG_PATTERN), F.lit(False))


def generic_title(c: Column, p: Column) -> Column:
    """A placeholder, or one before a dash or bar on a page that is not the root."""
    low = F.lower(F.trim(c))
    first = F.trim(F.regexp_extract(low, r"^(.*?)\s*(?:[|\x{2013}\x{2014}-]|$)", 1))
    return F.coalesce(low.isin(*fixed.PLACEHOLDER_TITLES) | (~p.isin("/", "") & first.isin(*fixed.PLACEHOLDER_TITLES)), F.lit(False))
