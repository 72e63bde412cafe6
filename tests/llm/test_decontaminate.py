import hashlib
import random
import re

import numpy as np

from lensaudit.llm import common
from lensaudit.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _words(t):
    return WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))


def _brute(doc, items):
    w = _words(doc)
    hit, found = set(), set()
    for k, t in items:
        v = _words(t)
        m = min(13, len(v))
        for i in range(len(v) - m + 1) if v else ():
            for j in range(len(w) - m + 1):
                if w[j : j + m] == v[i : i + m]:
                    hit |= set(range(j, j + m))
                    found.add(k)
    return w, hit, sorted(str(k) for k in found if k is not None)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_WORDS", 60)  # several automata
    rng = random.Random(5)
    vocab = ["a", "b", "é", "x9", "W"]
    item = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, item(rng.randrange(9, 30))) for i in range(12)] + [(3, item(20)), (90, None), (91, "..."), (92, "zz yy"), (None, "qq rr ss"), (93, "A-b_C")]
    docs = [(i, " - ".join(filter(None, (item(rng.randrange(40)), rng.choice(items)[1], item(rng.randrange(40)))))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "qq rr ss tt"), (103, items[0][1]), (103, items[0][1]), (None, "zz YY"), (104, "word " * 20000)]
    df = spark.createDataFrame([(k, t, True) for k, t in docs], "doc_id long, text string, n_hit boolean")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for k, t in docs:
        w, hit, found = _brute(t, items)
        want.append((k, len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    assert sorted(map(tuple, D.contamination(df, bench).collect()), key=repr) == sorted(want, key=repr)
    clean = {(r.doc_id, r.text) for r in D.decontaminate(df, bench).collect()}
    assert clean == {d for d, x in zip(docs, want) if not x[5]}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(none, items).collect() == []
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [tuple(r)[:4] for r in D.contamination(one, items).collect()] == [(1, 2, 0, 0)]


def test_spans_are_cut_from_first_to_last_byte():
    text = "Keep é, one two three. And keep"
    assert D.cut_spans(text, np.array([0, 0, 1, 1, 1, 0, 0], bool), 3) == "Keep é, . And keep"
    assert D.cut_spans(text, np.array([0, 0, 1, 1, 0, 0, 0], bool), 3) == text


def test_blocks_of_small_partitions_are_joined_and_large_benchmarks_split(spark, monkeypatch):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 40)))) for i in range(60)]
    docs = [(i, " ".join([rng.choice(items)[1], "zz", items[i % 60][1], "y y", items[(i * 7) % 60][1][: 5 * i]])) for i in range(40)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string").repartition(9)
    one = D._write_items(b, common.work_dir(spark, "t"))
    assert len(one) == 1 and len(one[0]) > 1
    want = sorted(map(tuple, D.contamination(d, b).collect()))
    monkeypatch.setattr(D, "BLOCK_WORDS", 60)
    many = D._write_items(b, common.work_dir(spark, "t"))
    assert len(many) > 2 * D.KEPT and sorted(map(tuple, D.contamination(d, b).collect())) == want


def test_a_long_match_is_marked_once_a_word():
    ws = [str(i).encode() for i in range(5000)]
    auto = D.Automaton([("a", ws)])
    got = list(auto.stream([auto.vocab[w] for w in ws]))
    assert len(got) == 5000 - 12 and all(j - i + 1 == 13 for i, j, _ in got)


def test_automata_beyond_those_kept(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_WORDS", 30)
    monkeypatch.setattr(D, "KEPT", 1)
    rng = random.Random(8)
    item = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(i, item(rng.randrange(1, 25))) for i in range(15)]
    docs = [(i, " . ".join((item(rng.randrange(30)), rng.choice(items)[1]))) for i in range(40)]
    uris = D._write_automata(spark.createDataFrame(items, "item_id long, text string").coalesce(1), D.WINDOW)
    assert len(uris) > 3
    automata = D._Items(uris)
    for _ in range(2):  # a second batch meets the same ones
        for (_, t), (hit, names) in zip(docs, D.scan([t for _, t in docs], automata)):
            w, want, found = _brute(t, items)
            assert (set(np.flatnonzero(hit)), sorted(names)) == (want, found)
    assert len(automata._kept) == 1


def test_a_frozen_automaton_is_the_same_however_often_it_is_built():
    items = [("b", [b"x", b"y"] * 20), ("a", [b"x", b"y"] * 9), (None, [b"z"]), ("c", [b"z"])]
    assert D.Automaton(items).frozen() == D.Automaton(items).frozen()
    flat = D.Frozen(D.Automaton(items).frozen())
    assert [names for _, _, names in flat.stream([2])] == [{"c"}, {None}]
    assert D.Frozen(D.Automaton([]).frozen()).vocab == {}
