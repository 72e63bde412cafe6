import random

import numpy as np

from lensaudit.llm import quality as Q


def _docs(n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9)))
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.3
        ws = [word() for _ in range(rng.randrange(20, 200))]
        text = " ".join(w.upper() + "!!" if bad and rng.random() < 0.7 else w for w in ws) + "."
        docs.append((i, text, int(bad)))
        labels.append((i, int(not bad)))
    return docs, labels


def test_held_out_accuracy_and_no_use_of_held_out_labels(spark):
    docs, labels = _docs(600)
    d = spark.createDataFrame(docs, "doc_id long, text string, quality int")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in Q.classify(d, lab).collect()}
    truth = dict(labels)
    out = [r for r in got.values() if r.held_out]
    assert 150 < len(out) < 250 and np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.97
    flipped = spark.createDataFrame([(i, 1 - q if got[i].held_out else q) for i, q in labels], "doc_id long, quality int")
    assert {r.doc_id: r.score for r in Q.classify(d, flipped).collect()} == {i: r.score for i, r in got.items()}
    assert {r.doc_id for r in Q.keep_good(d, lab).collect()} == {i for i, r in got.items() if r.predicted}


def test_odd_rows_and_no_labels(spark):
    d = spark.createDataFrame([(None, None), (1, ""), (2, "x " * 50000), (2, "x " * 50000), (3, "\n\n"), (4, "ü")], "doc_id long, text string")
    rows = Q.classify(d, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert [(r.score, r.predicted) for r in rows] == [(0.5, 1)] * 6
    assert Q.classify(d.where("false"), spark.createDataFrame([(1, None), (None, 1), (2, 1)], "doc_id long, quality int")).collect() == []


def test_repeated_ids_train_alike_in_any_order(spark):
    docs, labels = _docs(200)
    docs += [(k, t + " more", q) for k, t, q in docs[:80]] + docs[:50]
    lab = spark.createDataFrame(labels + [(k, 1 - q) for k, q in labels[:40]], "doc_id long, quality int")
    one, two = (Q.fit(spark.createDataFrame(x, "doc_id long, text string, quality int").repartition(n), lab) for x, n in ((docs, 2), (docs[::-1], 7)))
    assert np.array_equal(one.value, two.value) and np.array_equal(one.threshold, two.threshold) and np.ptp(one.value) > 0


def test_names_that_clash_and_long_texts(spark):
    d = spark.createDataFrame([(1, "word " * 400_000, 0.5, "x", 3), (2, None, 0.1, "y", 4)], "doc_id long, text string, score double, th string, quality int")
    lab = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert sorted(Q.keep_good(d, lab).drop("text").collect()) == sorted(d.drop("text").collect())


def test_flattened_trees_equal_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, len(Q.FEATURES)))
    model = Q.grow(x, (x[:, 3] * x[:, 5] > 0).astype(float), trees=10)
    for row, s in zip(x[:50], model.score(x[:50])):
        total = model.base
        for t in range(len(model.feature)):
            i = 0
            while (model.left[t, i] if row[model.feature[t, i]] <= model.threshold[t, i] else model.right[t, i]) != i:
                i = model.left[t, i] if row[model.feature[t, i]] <= model.threshold[t, i] else model.right[t, i]
            total += model.value[t, i]
        assert abs(1 / (1 + np.exp(-total)) - s) < 1e-9


def test_the_first_split_is_the_best_of_all():
    """One tree of one level against every feature and threshold."""
    rng = np.random.default_rng(4)
    for _ in range(5):
        x = np.round(rng.normal(size=(300, len(Q.FEATURES))), 1)  # many equal values
        y = ((x[:, 7] > 0.3) | (rng.random(300) < 0.2)).astype(float)
        model = Q.grow(x, y, trees=1, depth=1, bins=16, least=20, ridge=1.0)
        p = 1 / (1 + np.exp(-model.base))
        g, h = y - p, np.full(300, p * (1 - p))

        def gain(left, g=g, h=h):
            part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1.0)
            return part(left) + part(~left) - part(left | ~left)

        best = max(gain(left) for j in range(x.shape[1]) for t in np.quantile(x[:, j], np.linspace(0, 1, 17)[1:-1], method="lower") if 20 <= (left := x[:, j] <= t).sum() <= 280)
        mine = x[:, model.feature[0, 0]] <= model.threshold[0, 0]
        assert abs(gain(mine) - best) < 1e-9
        for node, rows in ((1, mine), (2, ~mine)):
            assert abs(model.value[0, node] - 0.15 * g[rows].sum() / (h[rows].sum() + 1.0)) < 1e-9
