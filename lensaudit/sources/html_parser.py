"""Page structure by a tolerant HTML parser, for pages that regular expressions misread.

Yields the columns of ``functions.html`` from any markup: unclosed tags, unquoted
attributes, text in scripts that looks like tags. Narrow: no shuffle.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from . import shared

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SCHEMA = "title string, description string, canonical string, canonical_count int, lang string, robots_meta string, meta_tags map<string, string>, headings array<struct<level: int, text: string>>, time_datetimes array<string>, has_main boolean, body_text string, ld_blocks array<string>"
_ARROW = pa.schema([
    ("title", pa.string()), ("description", pa.string()), ("canonical", pa.string()), ("canonical_count", pa.int32()), ("lang", pa.string()), ("robots_meta", pa.string()),
    ("meta_tags", pa.map_(pa.string(), pa.string())), ("headings", pa.list_(pa.struct([("level", pa.int32()), ("text", pa.string())]))), ("time_datetimes", pa.list_(pa.string())),
    ("has_main", pa.bool_()), ("body_text", pa.string()), ("ld_blocks", pa.list_(pa.string())),
])


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found = {"title": None, "canonical": None, "lang": None, "has_main": False, "canonical_count": 0}
        self.meta, self.metas, self.heads, self.times, self.body, self.blocks = {}, {}, [], [], [], []
        self.title, self.head, self.skip, self.block = None, [], None, None

    def handle_starttag(self, tag, attrs):
        a = {}
        for k, v in attrs:
            a.setdefault(k, v or "")
        if tag == "html" and self.found["lang"] is None:
            self.found["lang"] = a.get("lang")
        elif tag == "title" and self.found["title"] is None and self.title is None:
            self.title = []
        elif tag == "meta":
            key, content = a.get("name") or a.get("property") or "", a.get("content", "").strip()
            if "name" in a:
                self.metas.setdefault(a["name"], content or None)
            if key and content:
                self.meta[key] = content
        elif tag == "link" and a.get("rel") == "canonical":
            self.found["canonical_count"] += 1
            if self.found["canonical_count"] == 1:
                self.found["canonical"] = a.get("href")
        elif tag == "time" and a.get("datetime", "").strip():
            self.times.append(a["datetime"].strip())
        elif tag == "main" or tag == "div" and a.get("role") == "main":
            self.found["has_main"] = True
        elif tag in ("script", "style"):
            self.skip = tag
            self.block = [] if tag == "script" and a.get("type", "").strip().lower() == "application/ld+json" else None
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.head.append((int(tag[1]), []))

    def handle_endtag(self, tag):
        if tag == "title" and self.title is not None:
            self.found["title"], self.title = "".join(self.title).strip(), None
        elif tag == self.skip:
            if self.block is not None:
                self.blocks.append("".join(self.block))
            self.skip = self.block = None
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            for i in range(len(self.head) - 1, -1, -1):
                if self.head[i][0] == int(tag[1]):
                    level, parts = self.head.pop(i)
                    self.heads.append((level, "".join(parts)))
                    break

    def handle_data(self, data):
        if self.skip:
            if self.block is not None:
                self.block.append(data)
            return
        if self.title is not None:
            self.title.append(data)
            return
        if text := data.strip():
            self.body.append(text)
            for _, parts in self.head:
                parts.append(text)


def read(html: str | None) -> dict:
    page = _Page()
    page.feed(html or "")
    page.close()
    page.heads += [(level, "".join(parts)) for level, parts in page.head]  # never closed
    heads = sorted(((level, text) for level, text in page.heads), key=lambda h: h[0])  # stable: levels in order
    return page.found | {"description": page.metas.get("description"), "robots_meta": page.metas.get("robots"), "meta_tags": list(page.meta.items()), "headings": [{"level": n, "text": t} for n, t in heads], "time_datetimes": page.times, "body_text": " ".join(page.body), "ld_blocks": page.blocks}


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with the columns of SCHEMA in place of ``html``."""
    rest = [c for c in pages.columns if c != html]

    def run(batches):
        for b in shared.slices(batches, html):
            got = pa.RecordBatch.from_pylist([read(x.as_py()) for x in b.column(html)], _ARROW)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *got.columns], [*rest, *_ARROW.names])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name != html)
    return pages.mapInArrow(run, f"{kept}, {SCHEMA}" if kept else SCHEMA)
