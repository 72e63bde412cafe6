import random

from lensaudit.llm import line_dedup as L


def _lines(t):
    return [x.strip() for x in (t or "").encode().split(b"\n") if x.strip()]


def _windows(lines, least):
    """(first, last) of the shortest runs of whole lines, ending at each line, of enough words."""
    out = []
    for j in range(len(lines)):
        n = 0
        for i in range(j, -1, -1):
            n += len(lines[i].split())
            if n >= least:
                out.append((i, j))
                break
    return out


def _docs(seed, n=60):
    rng = random.Random(seed)
    line = lambda k: " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(k))
    pool = [[line(rng.randrange(1, 9)) for _ in range(rng.randrange(1, 6))] for _ in range(8)]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(5)):
            parts += rng.choice(pool) if rng.random() < 0.5 else [line(rng.randrange(1, 9))]
            parts += [""] * rng.randrange(2)
        docs.append((i, "\n".join(parts)))
    return docs + [(n, None), (n + 1, ""), (n + 2, "\n \n"), (n + 3, docs[3][1]), (n + 4, "same line of six words here\n" * 50), (n + 5, "x " * 3000)]


def test_repeated_windows_go_and_nothing_else(spark):
    """Complete: every line of a window that came before is gone. Sound: what is gone lies in a
    run that stands, as a whole, at an earlier place."""
    for seed, least in ((1, 10), (2, 6)):
        docs = _docs(seed)
        df = spark.createDataFrame([(k, t, "keep", 9) for k, t in docs], "doc_id long, text string, lang string, n_lines int")
        runs = {r.did: [(x.i, x.j) for x in r.runs] for r in L.repeated_runs(df.select("doc_id", "text"), least).collect()}
        lines = {k: _lines(t) for k, t in docs}
        first = {}
        for k in sorted(lines):
            for i, j in _windows(lines[k], least):
                first.setdefault(tuple(lines[k][i : j + 1]), (k, i))
        gone = {k: {x for i, j in rs for x in range(i, j + 1)} for k, rs in runs.items()}
        for k in lines:
            for i, j in _windows(lines[k], least):
                d, at = first[tuple(lines[k][i : j + 1])]
                if (d, at) != (k, i) and (d != k or i > at + j - i):
                    assert set(range(i, j + 1)) <= gone.get(k, set())
        where = lambda run, k, i: any(lines[d][a : a + len(run)] == run for d in lines if d <= k for a in range(len(lines[d]) - len(run) + 1) if d < k or a + len(run) <= i)
        for k, rs in runs.items():
            for i, j in rs:
                run = lines[k][i : j + 1]
                assert sum(len(x.split()) for x in run) >= least and where(run, k, i)
        out = {r.doc_id: r for r in L.dedup_lines(df, least).collect()}
        assert len(out) == len(docs) and {r.lang for r in out.values()} == {"keep"}
        for k, t in docs:
            assert out[k].n_lines == len(lines[k]) and out[k].removed_lines == len(gone.get(k, ()))
            assert _lines(out[k].text) == [x for i, x in enumerate(lines[k]) if i not in gone.get(k, ())]
            if k not in gone:
                assert out[k].text == t


def test_first_occurrence_stays_and_repeats_of_one_document_go(spark):
    text = "\n".join(f"line {i} of a passage that is long enough" for i in range(8))
    df = spark.createDataFrame([(5, "own start\n" + text), (2, text + "\nown end"), (9, text), (9, text), (None, "a b")], "doc_id long, text string")
    got = {(r.doc_id, r.text) for r in L.dedup_lines(df).collect()}
    assert got == {(5, "own start"), (2, text + "\nown end"), (9, ""), (None, "a b")}
    clash = df.selectExpr("*", "1 AS _did", "2 AS _RUNS", "3 AS th")
    assert L.dedup_lines(clash).columns == [*clash.columns, "n_lines", "removed_lines", "removed_words"] and L.dedup_lines(clash).count() == 5
    twice = spark.createDataFrame([(1, text + "\nbetween\n" + text)], "doc_id long, text string")
    assert L.dedup_lines(twice).collect()[0].text == text + "\nbetween"


def test_empty_table(spark):
    assert L.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_lines_before_a_window_that_repeat_a_later_occurrence_go(spark):
    """The first occurrences of the long line L stand without S, and without T, S."""
    long, short, more = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("l", 60), ("s", 20), ("t", 20)))
    docs = [(1, "x\n" + long), (2, f"{short}\n{long}"), (3, f"{more}\n{short}\n{long}"), (4, f"own\n{more}\n{short}\n{long}\nend")]
    got = {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: docs[0][1], 2: short, 3: more, 4: "own\nend"}


def test_every_run_of_an_earlier_document_goes(spark):
    docs, least = [(k, t) for k, t in _docs(5, 80) if len(_lines(t)) < 40], 10
    runs = {r.did: {x for g in r.runs for x in range(g.i, g.j + 1)} for r in L.repeated_runs(spark.createDataFrame(docs, "doc_id long, text string"), least).collect()}
    seen = set()
    for k, t in docs:
        ls = _lines(t)
        whole = [(i, j) for i in range(len(ls)) for j in range(i, len(ls)) if sum(len(x.split()) for x in ls[i : j + 1]) >= least]
        for i, j in whole:
            assert tuple(ls[i : j + 1]) not in seen or set(range(i, j + 1)) <= runs.get(k, set())
        seen |= {tuple(ls[i : j + 1]) for i, j in whole}
