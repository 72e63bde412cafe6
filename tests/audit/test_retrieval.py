import random

import pytest

from lensaudit.operators import retrieval


def words(rng, n):
    """Frequent words and rare ones."""
    return " ".join(rng.choice(["the", "of", "and", "a"]) if rng.random() < 0.5 else f"w{int(rng.paretovariate(0.6)) % 3000}" for _ in range(n))


@pytest.mark.parametrize("k", [1, 4])
def test_corpus_top_k_equals_all_pairs(spark, k):
    rng = random.Random(k)
    chunks = [("p", i, "", words(rng, rng.choice([1, 3, 8, 20, 60, 200]))) for i in range(400)] + [("p", 400, "", ""), ("p", 401, "w1", "the"), ("q", 0, "", "the of"), ("q", 1, "", "the of")]
    asks = [(i, words(rng, rng.choice([1, 2, 5, 12]))) for i in range(40)] + [(90, ""), (91, "nowhere"), (92, "the"), (93, "the of"), (94, "nowhere the w1")]
    of = lambda t: set(t.lower().split())
    want = []
    for q, text in asks:
        scores = [(-len(of(text) & of(f"{h} {t}")) / (len(of(text)) * len(of(f"{h} {t}"))) ** 0.5, p, i) for p, i, h, t in chunks if of(text) & of(f"{h} {t}")]
        want += [(q, r + 1, p, i, round(-s, 9)) for r, (s, p, i) in enumerate(sorted(scores, key=lambda x: (round(x[0], 12), *x[1:]))[:k])]
    c, q = spark.createDataFrame(chunks, "page string, chunk_idx int, heading_path string, text string"), spark.createDataFrame(asks, "q_id long, question string")
    got = retrieval.lexical_top_k_corpus(q, c, ["page"], k)
    assert sorted((r.q_id, r["rank"], r.page, r.chunk_idx, round(r.score, 9)) for r in got.collect()) == sorted(want)


def test_frequent_words_alone_make_no_pairs(spark):
    """Every chunk has the question's frequent words; five have its rare ones too."""
    rng = random.Random(1)
    chunks = [("p", i, "", "the of and a " + " ".join(f"w{rng.randrange(10_000)}" for _ in range(20))) for i in range(2000)]
    chunks += [("p", 2000 + i, "", "the of and a zebra quagga " + " ".join(f"v{j}" for j in range(18))) for i in range(5)]
    from pyspark.sql import functions as F

    from lensaudit.functions import text as T

    c = spark.createDataFrame(chunks, "page string, chunk_idx int, heading_path string, text string").select("page", "chunk_idx", T.tokens(F.col("text")).alias("_t"))
    q = spark.createDataFrame([(1, "the of and a zebra quagga")], "q_id long, question string").select("q_id", T.tokens(F.col("question")).alias("_q"))
    assert retrieval.candidates(q, c, ["page"], 5).count() == 5


def test_only_words_that_a_page_is_asked_for_become_rows(spark):
    from pyspark.sql import functions as F

    asked = spark.createDataFrame([("p", 1, 2, "zebra"), ("p", 1, 2, "w5"), ("q", 2, 1, "w7")], "page string, q_id int, nq int, term string")
    chunks = [("p", 0, [f"w{i}" for i in range(100)]), ("p", 1, ["zebra", "w5", "x"]), ("q", 0, ["w5", "w7"]), ("q", 1, ["w5"]), ("r", 0, ["w5"])]
    got = retrieval.sought(asked, spark.createDataFrame(chunks, "page string, chunk_idx int, _t array<string>"), ["page"])
    assert sorted(map(tuple, got.collect())) == [("p", 0, 100, "w5"), ("p", 1, 3, "w5"), ("p", 1, 3, "zebra"), ("q", 0, 2, "w7")]
    q = spark.createDataFrame([("p", 1, "Zebra w5"), ("p", 3, ""), ("q", 2, "w7"), ("r", 4, "none")], "page string, q_id int, question string")
    c = spark.createDataFrame(chunks, "page string, chunk_idx int, _t array<string>").select("page", "chunk_idx", F.lit("").alias("heading_path"), F.array_join("_t", "\u3000\n").alias("text"))
    top = retrieval.lexical_top_k(q, c, ["page"], 2).collect()
    want = [(1, 1, 1, 0.816497), (1, 2, 0, 0.070711), (2, 1, 0, 0.707107), (2, 2, 1, 0.0), (3, 1, 0, 0.0), (3, 2, 1, 0.0), (4, 1, 0, 0.0)]
    assert sorted((r.q_id, r["rank"], r.chunk_idx, round(r.score, 6)) for r in top) == want


def test_corpus_texts_are_read_once(spark):
    """Chunks of no page are of the corpus too, and two of one number stay two."""
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    def say(i):
        seen.add(1)
        return f"the of w{i}"

    chunks = spark.range(50).select(F.expr("CASE WHEN id <> 7 THEN 'p' END").alias("page"), F.expr("CAST(if(id = 9, 8, id) AS INT)").alias("chunk_idx"), F.lit("").alias("heading_path"), F.udf(say)("id").alias("text"))
    q = spark.createDataFrame([(1, "the w7"), (2, "w8 W9"), (3, "nowhere")], "q_id long, question string")
    got = retrieval.lexical_top_k_corpus(q, chunks, ["page"], 2)
    rows = sorted((r.q_id, r["rank"], r.page, r.chunk_idx, round(r.score, 6)) for r in got.collect())
    assert rows == [(1, 1, None, 7, 0.816497), (1, 2, "p", 0, 0.408248), (2, 1, "p", 8, 0.408248), (2, 2, "p", 8, 0.408248)]
    assert seen.value == 50


def test_a_block_of_vectors_is_scored_by_slices():
    """Not all scores of a block are held at once; they are those of the whole product."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from lensaudit.operators import retrieval

    n, k = 2048, 3
    v = np.random.default_rng(1).integers(-9, 9, (n, 4)).astype(float)
    rows = pa.chunked_array([pa.array(list(v))])
    tracemalloc.start()
    at, score = retrieval.nearest(rows, rows, k)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < n * n * 8
    unit = retrieval.unit_rows(rows)
    whole = np.round(unit @ unit.T, 12) + 0.0
    want = np.argsort(-whole, axis=1, kind="stable")[:, :k]
    assert (at.reshape(n, k) == want).all() and (score.reshape(n, k) == np.take_along_axis(whole, want, 1)).all()
