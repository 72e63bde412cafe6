import random

import numpy as np
import pytest

from lensaudit.llm import jaccard_join as J


def _sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    return out


def _brute(rows):
    sets = _sets([t for _, t in rows])
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                comp[root(i)] = root(j)
    ids = {}
    for i, (k, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(k)
    low = {r: min((k for k in ks if k is not None), default=None) for r, ks in ids.items()}
    return sorted(((k, len(sets[i]), low[root(i)] if sets[i] else k) for i, (k, _) in enumerate(rows)), key=repr)


def _rows(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows = []
    for i in range(n):
        kind = rng.randrange(6)
        if kind == 0 or not rows:
            t = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 120)))
        elif kind == 1:
            t = rng.choice(rows)[1]
        elif kind == 2:
            t = passage + " " + " ".join(rng.choice(words) for _ in range(rng.randrange(20)))
        else:
            w = (rng.choice(rows)[1] or "x").split()
            for _ in range(rng.randrange(1, 5)):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = [rng.choice(words).upper()]
            t = " ".join(w)
        rows.append((i, t))
    rng.shuffle(rows)
    return rows + [(n, None), (n + 1, ""), (n + 2, "one"), (n + 3, "ONE"), (n + 4, " \t\n"), (n + 5, "a b c d e"), (n + 6, "long " * 5000)]


@pytest.mark.parametrize("frequent", [True, False])
def test_components_against_brute_force(spark, monkeypatch, frequent):
    if frequent:  # small blocks, so that some shingles are put last and lists are long
        monkeypatch.setattr(J, "SHORT_LIST", 3)
        monkeypatch.setattr(J, "BLOCK_SETS", 4)
        monkeypatch.setattr(J, "STREAM_SETS", 3)
        monkeypatch.setattr(J, "BLOCK_SHINGLES", 400)
    rows = _rows(int(frequent))
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, cid int")
    assert sorted(map(tuple, J.link_components(df).collect()), key=repr) == _brute(rows)


def test_null_ids_repeats_and_empty(spark):
    text = "a b c d e f g"
    rows = [(None, text), (None, "p q r s t u v"), (4, text), (4, text), (9, text + " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = df.selectExpr("*", "1 AS _d", "2 AS _TH", "3 AS comp")
    assert J.keep_one(clash).columns == clash.columns and J.keep_one(clash).count() == 2
    assert sorted(map(tuple, J.link_components(df).collect()), key=repr) == _brute(rows)
    kept = sorted(map(tuple, J.keep_one(df).collect()), key=repr)
    assert kept == [(4, text), (None, "p q r s t u v")]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert J.link_components(none).collect() == [] and J.keep_one(none).collect() == []


def test_hashes_do_not_depend_on_the_batch():
    texts = [b"The quick  brown\tfox jumps over", b"", b"the QUICK brown fox jumps over", "é à ü ß".encode(), b"x"]
    one = [J.shingle_sets([t])[0].tolist() for t in texts]
    assert one == [s.tolist() for s in J.shingle_sets(texts)] and one[0] == one[2] and one[1] == []
    assert all(np.all(np.diff(np.array(s).astype(object)) > 0) for s in one if len(s) > 1)


@pytest.mark.parametrize("most", [0, 10**6])
def test_both_ways_to_contract_links(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(J, "TASK_LINKS", most)
    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)]
    got = {r.node: r.root for r in J.components(spark.createDataFrame(edges, "a long, b long"), f"file://{tmp_path}").collect()}
    low = {x: x for e in edges for x in e}
    for _ in low:
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    assert all(got.get(x, x) == r for x, r in low.items()) and set(got) <= set(low)


def test_sketches_rule_out_only_what_is_not_similar():
    rng = np.random.default_rng(4)
    ruled = 0
    for _ in range(400):
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 300)), dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.random() ** 0.2], rng.integers(0, 1 << 63, int(rng.integers(0, 40)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        is_ = 100 * both >= 80 * (len(a) + len(b) - both)
        may = J.may_be_similar(J.sketch(a), len(a), J.sketch(b), len(b))
        assert may or not is_
        ruled += not may
    assert ruled > 100
