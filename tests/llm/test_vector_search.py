import math
import random

import pytest

from lensaudit.llm import vector_search as V


def _brute(rows, k, every, scale):
    good = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(good):
        if i % every == 0:
            got = sorted(((-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(good) if m != n and len(v) == len(q)))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(got)]
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 37)
    monkeypatch.setattr(V, "QUERY_BLOCK", 3)
    monkeypatch.setattr(V, "CELLS", 8)  # coarse cells: bounds are loose and exact vectors decide
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)]) for i in range(300)]
    rows += [(i, [0.5] * 6) for i in range(300, 330)] + [(330, None), (331, []), (332, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (333, [float("nan")] * 6), (334, [float("inf")] * 6), (None, [0.1] * 6), (340, [0.2, 0.3]), (345, [0.1, -0.3])]
    df = spark.createDataFrame([(i, v, 0.5) for i, v in rows], "vec_id long, embedding array<float>, score double").repartition(3)
    exact = [(i, v) for i, v in df.select("vec_id", "embedding").collect()]
    got = V.top_k(df, k=7, every=5)
    assert sorted(map(tuple, got.collect())) == _brute(exact, 7, 5, 64.0)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (20, [2.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, V.top_k(df).collect())) == [(0, 1, 20, 8192), (20, 1, 0, 8192)]
    assert V.top_k(df.where("false")).collect() == []


def test_large_components_are_exact_and_only_scores_that_leave_a_long_fail(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1, 1]) * rng.uniform(1e6, 1.7e7) for _ in range(6)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, V.top_k(df, k=7, every=5).collect())) == _brute(rows, 7, 5, 64.0)
    few = [(0, [1.0, 2.0]), (1, [5e7, 0.5]), (20, [0.5, 1.0])]  # one far row, whose scores still fit
    assert sorted(map(tuple, V.top_k(spark.createDataFrame(few, df.schema)).collect())) == _brute(few, 20, 20, 64.0)
    with pytest.raises(Exception, match="64 bits"):
        V.top_k(spark.createDataFrame([(0, [1e9] * 2), (1, [1e9] * 2)], df.schema)).collect()


@pytest.mark.parametrize("most", [1e9, 1e18, 1e300])
def test_far_rows_behind_the_first_do_no_harm(spark, monkeypatch, most):
    """Scores under the first k may leave a long, in any dtype of a block; those of the first k fit."""
    monkeypatch.setattr(V, "BLOCK", 16)
    monkeypatch.setattr(V, "QUERY_BLOCK", 4)
    rng = random.Random(7)
    rows = [(i, [rng.uniform(1, 3) for _ in range(4)]) for i in range(60)] + [(100 + i, [-most * rng.uniform(0.5, 1), 1.0, 0.0, 2.0]) for i in range(20) if (100 + i) % 5]
    rows += [(200 + i, [0.0, 0.0, 0.0, -rng.random()]) for i in range(8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert sorted(map(tuple, V.top_k(df, k=7, every=5).collect())) == _brute(rows, 7, 5, 64.0)
    assert V.top_k(spark.createDataFrame([(0, [1e307 * 10]), (20, [1.0])], df.schema)).collect() == []  # not finite once scaled
