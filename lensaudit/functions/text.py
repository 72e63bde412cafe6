"""Text expressions: tokens, similarity, spans. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space of any script, and the separators U+001C to U+001F.
SPACE = r"[\p{IsWhite_Space}\x{1C}-\x{1F}]"


def strip(c: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; none at the ends. Null counts as empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), rf"{SPACE}+", " "))


def strip_tags(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", " "))


def tokens(c: Column) -> Column:
    """Distinct lower-case words; an empty array for blank text."""
    return F.array_remove(F.array_distinct(F.split(F.lower(F.coalesce(c, F.lit(""))), rf"{SPACE}+")), "")


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token arrays: 1 if both are empty, 0 if one is."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def approx_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))


def question_key(c: Column) -> Column:
    """Normalised question for removing repeats."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", ""))  # only spaces are left to strip


def span_needle(span: Column) -> Column:
    return F.substring(squeeze(F.lower(span)), 1, 120)


def span_probe(span: Column) -> Column:
    """The first twelve words of the needle."""
    return F.concat_ws(" ", F.slice(F.split(F.trim(span_needle(span)), " "), 1, 12))


def span_in(span: Column, text: Column) -> Column:
    """Whether a span, or its first twelve words, occurs in ``text``; an empty span never does."""
    hay = F.regexp_replace(F.lower(text), rf"{SPACE}+", " ")
    return F.coalesce((span_needle(span) != "") & (F.contains(hay, span_probe(span)) | F.contains(hay, span_needle(span))), F.lit(False))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def any_of(text: Column, needles) -> Column:
    """Whether lower-case ``text`` contains any needle, case-insensitively."""
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(text, F.lit(n.lower()))
    return out


def names_of(text: Column, groups: dict) -> Column:
    """Names of the groups of which some needle occurs in ``text``, in the groups' order."""
    named = lambda low: F.array_compact(F.array(*(F.when(any_of(low, needles), F.lit(name)) for name, needles in groups.items())))
    return bound(F.lower(F.coalesce(text, F.lit(""))), named)


def cache_key(*parts: Column) -> Column:
    """SHA-256 over the parts, each closed by NUL."""
    return F.sha2(F.concat(*(x for p in parts for x in (F.coalesce(p.cast("string"), F.lit("None")), F.lit("\0")))), 256)


def bar(share: Column, width: int = 22) -> Column:
    n = F.greatest(F.lit(0), F.least(F.lit(width), F.round(share * width).cast("int")))
    return F.concat(F.repeat(F.lit("█"), n), F.repeat(F.lit("░"), F.lit(width) - n))


def title_case(c: Column) -> Column:
    """Every run of letters with a capital first: also after digits and apostrophes."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))), "")
