"""Main text of pages by a tree of blocks, from any markup.

A block is the text between two block-level tags, in a container (div, section, list, ...).
Blocks are judged by their length and the share of it that lies in links, short ones by
the blocks around them in the smallest container that has others. Two profiles: *recall*
keeps all that is not boilerplate, *precision* only what is surely content, inside article
or main where there is one. Narrow: no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from .. import fixed
from . import shared

#: Elements whose text is never content, and those that are page furniture with all they hold.
DEAD = frozenset("head title script style template noscript iframe svg textarea select".split())
FURNITURE = frozenset("nav footer aside form button dialog menu".split())
CONTAINERS = frozenset("div section article main header ul ol dl table blockquote figure fieldset details center".split())
BREAKS = frozenset("p li dt dd tr td th caption figcaption pre summary address hr h1 h2 h3 h4 h5 h6 body html".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog menu menubar toolbar".split())
#: Whole class names or ids of containers that are furniture.
NAMES = frozenset("ad ads advert advertisement breadcrumb breadcrumbs cookie-banner cookies menu nav navbar navigation newsletter pagination popup promo related share sharing sidebar social sponsored toolbar".split())
#: Shorter blocks are judged by their neighbours; more than a third in links is a list of links.
SHORT, LINKED = 70, 1 / 3
#: Containers of one name directly in each other, nested deeper than this, count as one.
DEEPEST = 256
_CUT = re.compile(r"<[^<>]*\Z")


@dataclass
class Container:
    tag: str
    parent: Container | None
    depth: int
    zone: bool  # in article or main
    furniture: bool  # anywhere in page furniture
    inner: bool  # in page furniture inside article or main
    dead: bool
    first: int  # number of its first block
    end: int | None = None  # number after its last block; None while it is open
    more: int = 0  # open ones of the same name that count as this one


@dataclass
class Block:
    number: int
    home: Container
    level: int
    lines: list[str] = field(default_factory=list)
    link_chars: int = 0

    @property
    def text(self) -> str:
        return "\n".join(self.lines)

    @property
    def kind(self) -> str:
        """heading, links, short or long."""
        if self.level:
            return "heading"
        if self.link_chars > LINKED * sum(len(line) - line.count(" ") for line in self.lines):
            return "links"
        return "short" if len(self.text) < SHORT else "long"


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self._top = Container("", None, 0, False, False, False, False, 0)
        self._parts: list[str] = []
        self._linked = self._level = self._pre = self._link = 0

    def _break(self):
        """The block that is open ends."""
        lines = [x for x in (" ".join(line.split()) for line in "".join(self._parts).split("\n")) if x]
        if lines:
            self.blocks.append(Block(len(self.blocks), self._top, self._level, [" ".join(lines)] if self._level else lines, self._linked))
        self._parts, self._linked = [], 0

    def _open(self, tag: str, furniture: bool, dead: bool):
        up = self._top
        zone = up.zone or tag in ("article", "main")
        self._top = Container(tag, up, up.depth + 1, zone, up.furniture or furniture, up.inner or (furniture and up.zone), up.dead or dead, len(self.blocks))

    def handle_starttag(self, tag, attrs):
        if tag in DEAD:
            self._open(tag, False, True)
        elif tag in FURNITURE or tag in CONTAINERS:
            self._break()
            if self._top.depth >= DEEPEST and tag == self._top.tag and tag in CONTAINERS:
                self._top.more += 1
                return
            a = {k: (v or "").lower() for k, v in attrs}
            named = set(a.get("class", "").split()) | {a.get("id", "")}
            apart = tag in FURNITURE or a.get("role") in ROLES or "hidden" in a or a.get("aria-hidden") == "true"
            apart = apart or (tag == "header" and not self._top.zone) or (tag not in ("article", "main") and bool(named & NAMES))
            self._open(tag, apart, False)
        elif tag in BREAKS:
            self._break()
            if tag == "body":
                self._close("head")
            self._level = int(tag[1]) if tag[0] == "h" and tag[1:].isdigit() else 0
            self._pre += tag == "pre"
        elif tag == "br":
            self._parts.append("\n")
        elif tag == "a":
            self._link = any(k == "href" for k, _ in attrs)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in DEAD or tag == "a":  # others are read as open, as a browser does
            self.handle_endtag(tag)

    def _close(self, tag: str):
        c = self._top
        while c is not None and c.tag != tag:
            c = c.parent
        if c is None:
            return
        if c is self._top and c.more:
            c.more -= 1
            return
        while self._top is not c.parent:
            self._top.end, self._top = len(self.blocks), self._top.parent

    def handle_endtag(self, tag):
        if tag in DEAD:
            self._close(tag)
        elif tag in FURNITURE or tag in CONTAINERS:
            self._break()
            self._close(tag)
        elif tag in BREAKS:
            self._break()
            self._level = 0
            self._pre = max(0, self._pre - (tag == "pre"))
        elif tag == "a":
            self._link = False

    def handle_data(self, data):
        if not self._top.dead:
            self._parts.append(data if self._pre else data.replace("\n", " "))
            if self._link:
                self._linked += len("".join(data.split()))


def tree(html: str | None) -> list[Block]:
    """All blocks of a page in order. A tag that is cut off at the end is left out."""
    page = _Tree()
    page.feed(_CUT.sub("", html or ""))
    page.close()
    page._break()
    return page.blocks


def kept(blocks: list[Block], strict: bool) -> list[bool]:
    """Which of some blocks of a page are content; ``strict``: in doubt, not.

    Long blocks are, lists of links are not. A short one is as the nearest long or linked
    blocks before and after it, of the smallest container that has any: between two that
    differ, or beside one only that is not content, it is kept without links and not
    ``strict``; with none at all, if not ``strict``. A heading is as the next block that
    is none; the last ones are kept if not ``strict``.
    """
    kinds = [b.kind for b in blocks]
    before, after, last = [None] * len(blocks), [None] * len(blocks), None
    for i, kind in enumerate(kinds):
        before[i] = last
        last = i if kind in ("long", "links") else last
    last = None
    for i in range(len(blocks) - 1, -1, -1):
        after[i] = last
        last = i if kinds[i] in ("long", "links") else last
    keep, follows = [False] * len(blocks), not strict
    for i in range(len(blocks) - 1, -1, -1):
        b, kind = blocks[i], kinds[i]
        if kind == "heading":
            keep[i] = follows
            continue
        keep[i] = kind == "long" or (kind == "short" and _as_neighbours(b, [j for j in (before[i], after[i]) if j is not None], blocks, kinds, strict))
        follows = keep[i]
    return keep


def _as_neighbours(b: Block, near: list[int], blocks: list[Block], kinds: list[str], strict: bool) -> bool:
    c, found = b.home, []
    while near and not found:
        found = [kinds[j] for j in near if blocks[j].number >= c.first and (c.end is None or blocks[j].number < c.end)]
        c = c.parent or c
    if strict:
        return bool(found) and "links" not in found
    if "links" not in found:
        return True
    return found != ["links", "links"] and not b.link_chars


def profiles(blocks: list[Block]) -> tuple[list[Block], list[Block]]:
    """The blocks that recall and precision keep. Furniture around article or main, as a form
    around a whole page, takes nothing from precision."""
    wide = [b for b in blocks if not b.home.furniture]
    zone = [b for b in blocks if b.home.zone and not b.home.inner] or wide
    return tuple([b for b, k in zip(some, kept(some, strict)) if k] for some, strict in ((wide, False), (zone, True)))


def markdown(blocks: list[Block]) -> str:
    return "\n".join("#" * b.level + " " * (b.level > 0) + b.text for b in blocks)


def main_text(html: str | None) -> tuple[str, str]:
    """(text, mode) of a page: recall, or the longer of both profiles where recall finds little."""
    recall, precise = profiles(tree(html))
    text = markdown(recall)
    if len(text) < fixed.RECALL_FLOOR and len(strict := markdown(precise)) > len(text):
        return strict, "precision"
    return text, "recall" if text else "none"


def _replace(rows: DataFrame, html: str, schema: pa.Schema, ddl: str, read) -> DataFrame:
    """``rows`` with the columns of ``schema`` in place of ``html``: of each row as many as ``read`` yields."""
    rest = [c for c in rows.columns if c != html]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in shared.slices(batches, html):
            made, of = [], []
            for i, x in enumerate(b.column(html)):
                new = read(x.as_py())
                made += new
                of += [i] * len(new)
            got, b = pa.RecordBatch.from_pylist(made, schema), b.take(pa.array(of, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *got.columns], [*rest, *schema.names])

    left = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != html)
    return rows.mapInArrow(run, f"{left}, {ddl}" if left else ddl)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with text and extraction_mode in place of ``html``. Null and empty pages have no
    text and mode none."""
    schema = pa.schema([("text", pa.string()), ("extraction_mode", pa.string())])
    return _replace(pages, html, schema, "text string, extraction_mode string", lambda x: [dict(zip(schema.names, main_text(x)))])


def blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """A row for each block of ``pages``: its number, level (0: no heading), kind, chars, link_chars,
    text, and whether recall and precision keep it. Pages without text have no rows."""
    schema = pa.schema([("block", pa.int32()), ("level", pa.int32()), ("kind", pa.string()), ("chars", pa.int32()), ("link_chars", pa.int32()), ("text", pa.string()), ("recall", pa.bool_()), ("precision", pa.bool_())])

    def read(x):
        found = tree(x)
        recall, precise = ({b.number for b in some} for some in profiles(found))
        return [{"block": b.number, "level": b.level, "kind": b.kind, "chars": len(b.text), "link_chars": b.link_chars, "text": b.text, "recall": b.number in recall, "precision": b.number in precise} for b in found]

    return _replace(pages, html, schema, "block int, level int, kind string, chars int, link_chars int, text string, recall boolean, precision boolean", read)
