"""Main text by blocks: pages labelled by hand, and odd markup."""

import pytest

from lensaudit.sources import main_content as M

LONG = "A paragraph that says enough about its subject to be read as content, with more than seventy characters."
MORE = "Another paragraph with as many words as the first one has, so that nobody would take it for a caption at all."
LINKS = "".join(f'<li><a href="/{i}">Section {i}</a></li>' for i in range(6))


def recall(html):
    return [b.text for b in M.profiles(M.tree(html))[0]]


def precise(html):
    return [b.text for b in M.profiles(M.tree(html))[1]]


LABELLED = {
    # navigation in navigation, closed once each
    "nested nav": (f"<body><nav><ul><li><nav><a href=/>Home</a></nav></li></ul>Menu of all pages</nav><main><p>{LONG}</p></main></body>", [LONG], [LONG]),
    "nested aside": (f"<body><aside>One<aside>Two</aside>Three</aside><div><p>{LONG}</p></div></body>", [LONG], [LONG]),
    # menus that only their links tell
    "menu of divs": (f"<body><div><div><ul>{LINKS}</ul></div></div><div><h1>Title</h1><p>{LONG}</p></div></body>", ["Title", LONG], ["Title", LONG]),
    "separators in a menu": (f'<body><div><a href="/a">First section</a><p>|</p><p><a href="/b">Second</a></p></div><p>{LONG}</p></body>', [LONG], [LONG]),
    "links at the end": (f"<body><article><p>{LONG}</p><h2>Related</h2><ul>{LINKS}</ul></article></body>", [LONG], [LONG]),
    # a short line is as what its own container holds
    "caption": (f"<body><div><ul>{LINKS}</ul></div><div><p>Short.</p><p>{LONG}</p></div></body>", ["Short.", LONG], ["Short.", LONG]),
    "teaser between menus": (f"<body><ul>{LINKS}</ul><p>Read on</p><ul>{LINKS}</ul><p>{LONG}</p></body>", [LONG], [LONG]),
    # in doubt: recall keeps, precision does not
    "mixed": (f"<body><ul>{LINKS}</ul><p>By Ann</p><p>{LONG}</p></body>", ["By Ann", LONG], [LONG]),
    "short page": ("<html><head><title>Just a moment</title></head><body>wait</body></html>", ["wait"], []),
    # links in running text are content
    "links in text": (f'<body><p>{LONG} See <a href="/x">the other page</a>.</p></body>', [LONG + " See the other page."], [LONG + " See the other page."]),
    "anchors without href": (f"<body><p><a name=x>{LONG}</a></p></body>", [LONG], [LONG]),
    "roles, names and hidden": (f'<body><div role=navigation>{LONG}</div><div class="wide sidebar">{LONG}</div><div hidden>{LONG}</div><section aria-hidden=true>{LONG}</section><p>{MORE}</p></body>', [MORE], [MORE]),
    "a class that only contains a name": (f'<body class="menu-open"><div class="has-sidebar"><p>{LONG}</p></div></body>', [LONG], [LONG]),
    "header of an article": (f"<body><header><p>{MORE}</p></header><article><header><h1>T</h1></header><p>{LONG}</p></article></body>", ["T", LONG], ["T", LONG]),
    "two articles": (f"<body><article><p>{LONG}</p></article><p>{MORE}</p><article><p>{MORE}</p></article></body>", [LONG, MORE, MORE], [LONG, MORE]),
    "form around the page": (f"<body><form><article><p>{LONG}</p><form>Name</form></article></form></body>", [], [LONG]),
}


@pytest.mark.parametrize("name", LABELLED)
def test_labelled(name):
    html, wide, strict = LABELLED[name]
    assert (recall(html), precise(html)) == (wide, strict)


def test_text_and_mode():
    page = f"<body><form><main><h2>T  t<br>u</h2><p>{LONG}<br>\nline  two</p><pre>a\n  b</pre></main></form></body>"
    assert M.main_text(page) == (f"## T t u\n{LONG}\nline two\na\nb", "precision")
    assert M.main_text(None) == M.main_text("") == M.main_text("<p>") == ("", "none")
    assert M.main_text("<p>a &lt;b&gt; &amp; caf&eacute;")[0] == "a <b> & café"


def test_broken_markup():
    assert recall(f"<div><p>{LONG}<p>{MORE}</section></div></div>") == [LONG, MORE]
    assert recall(f"<p>{LONG}</p><nav><li>never closed <p>{MORE}") == [LONG]
    assert recall(f"<div><nav>x</div><p>{LONG}") == [LONG]  # the div ends the nav
    assert recall(f"<p>{LONG}</p><script>var t = '<p>{MORE}</p>'") == [LONG]
    assert recall(f"<p>{LONG}</p><div class='x") == [LONG]
    assert recall(f"<title>{MORE}</title><p>{LONG}") == [LONG]


def test_deep_and_wide_pages():
    deep = "<div>" * 3000 + f"<p>{LONG}</p>" + "</div>" * 3000 + f"<nav>x</nav><p>{MORE}</p>"
    assert recall(deep) == [LONG, MORE]
    wide = f"<div><ul>{LINKS}</ul></div>" + "<p>ab</p>" * 30000
    assert len(recall(wide)) == 30000  # one-sided: nothing but links before them


def test_neighbours_against_a_slow_reading():
    """Every short block, by looking at all blocks of every container around it."""
    import random

    rng = random.Random(3)

    def page(depth):
        out = ""
        for _ in range(rng.randrange(1, 5)):
            out += rng.choice([f"<p>{LONG}</p>", "<p>few words</p>", '<p>by <a href="/a">someone there</a></p>', '<p>few words and <a href="/a">a</a></p>', "<h3>Part</h3>", f"<div>{page(depth - 1)}</div>" if depth else "", f"<section>{page(depth - 1)}</section>" if depth else ""])
        return out

    def slow(bs, strict):
        keep = {}
        for i in range(len(bs) - 1, -1, -1):
            b = bs[i]
            if b.kind == "heading":
                rest = [j for j in range(i + 1, len(bs)) if bs[j].kind != "heading"]
                keep[i] = keep[rest[0]] if rest else not strict
            elif b.kind != "short":
                keep[i] = b.kind == "long"
            else:
                c, near = b.home, []
                while c is not None and not near:
                    inside = [j for j, x in enumerate(bs) if c in _up(x.home) and x.kind in ("long", "links")]
                    near = [bs[j].kind for j in ([j for j in inside if j < i][-1:] + [j for j in inside if j > i][:1])]
                    c = c.parent
                links = near.count("links")
                keep[i] = (bool(near) and not links) if strict else (not links or (links < 2 and not b.link_chars))
        return [keep[i] for i in range(len(bs))]

    def _up(c):
        while c is not None:
            yield c
            c = c.parent

    for _ in range(200):
        bs = M.tree(page(4))
        assert all(M.kept(bs, strict) == slow(bs, strict) for strict in (False, True))


def test_rows(spark):
    rows = [(1, f"<p>{LONG}</p><h2>End</h2>", "x"), (2, None, "y"), (3, "", None)]
    df = spark.createDataFrame(rows, "id int, html string, text_ string")
    assert sorted(map(tuple, M.extract(df).collect())) == [(1, "x", f"{LONG}\n## End", "recall"), (2, "y", "", "none"), (3, None, "", "none")]
    got = M.blocks(df).select("id", "block", "level", "kind", "recall", "precision").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, "long", True, True), (1, 1, 2, "heading", True, False)]
    assert M.blocks(df.limit(0)).collect() == []


def test_ratio_of_main_text_is_that_of_its_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    page = f"<p>{'x' * 995}</p>"
    pages = [(1, page + " " * (1600 - len(page))), (2, page), (3, ""), (4, None)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r.page_id, r.chars, r.ratio) for r in entry.queries()["main_text"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == con.execute(f"SELECT page_id, chars, ratio FROM ({entry.oracle_sql()['main_text']}) ORDER BY 1").fetchall()
    assert got == [(1, 995, 0.62187), (2, 995, round(995 / 1002, 5)), (3, 0, 0.0), (4, 0, 0.0)]


def test_a_large_batch_is_read_in_slices():
    """What is made of one batch does not grow with its rows or their length."""
    import pyarrow as pa

    from lensaudit.sources import shared

    texts = ["x" * 10, None, ""] * 300 + ["y" * (shared.SLICE_BYTES + 1)] * 2 + ["z" * (shared.SLICE_BYTES // 2)] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "html"])
    got = list(shared.slices([batch, batch.slice(0, 0)], "html"))
    assert [i for b in got for i in b.column("id").to_pylist()] == list(range(len(texts)))
    assert max(b.num_rows for b in got) <= shared.SLICE_ROWS and all(b.num_rows <= 1 or sum(len(t or "") for t in b.column("html").to_pylist()) <= shared.SLICE_BYTES for b in got)


def test_every_parser_of_pages_yields_slices(monkeypatch):
    import pyarrow as pa

    from lensaudit.operators import chunking
    from lensaudit.sources import html_parser, main_content, shared

    n = 3 * shared.SLICE_ROWS

    class Rows:
        """Takes what a step would run on each batch."""

        columns = ["id", "html"]

        class schema:
            def __iter__(self):
                return iter(())

        schema = schema()

        def select(self, *_):
            return self

        def mapInArrow(self, run, ddl):
            return [b.num_rows for b in run([pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(["<p>Some words.</p>"] * n), pa.array(["Some words."] * n)], ["id", "html", "_text"])])]

    monkeypatch.setattr(chunking.F, "col", lambda c: type("C", (), {"alias": lambda self, n: self})())  # without a session
    for step in (lambda r: html_parser.extract(r), lambda r: main_content.extract(r), lambda r: main_content.blocks(r), lambda r: chunking.chunks(r, ["id"])):
        sizes = step(Rows())
        assert len(sizes) == 3 and sum(sizes) == n
