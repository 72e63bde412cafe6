import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lensaudit.llm import lm_scoring as M


def _docs(n=300, seed=4):
    rng = random.Random(seed)
    lang = ["the of and to in is it on for as".split(), "le de la et les des en un du une".split()]
    out = []
    for i in range(n):
        ws = lang[i % 2]
        out.append((i, " ".join(rng.choice(ws) if rng.random() < 0.8 else ws[0] + str(rng.randrange(300)) for _ in range(rng.randrange(60)))))
    return out + [(n, None), (n + 1, ""), (n + 2, "The\tTHE\x1cé \n unseen-word"), (None, "of of"), (3, "repeated id")]


def test_counts_and_base_score_by_brute_force_and_model_beats_base(spark):
    docs = _docs()
    df = spark.createDataFrame([(k, t, 1.0) for k, t in docs], "doc_id long, text string, score double")
    got = sorted(map(tuple, M.score(df, stride=1).collect()), key=repr)
    low = {i: i + 32 for i in range(65, 91)}
    toks = [[*((t or "").translate(low).encode().split()), b""] for _, t in docs]
    out = [zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2 for k, _ in docs]
    c = Counter(w for ws, o in zip(toks, out) if not o for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted(((k, o, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for (k, _), ws, o in zip(docs, toks, out)), key=repr)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want])
    held = [r for r in got if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held) and all(r[6] < 0 for r in got)


def test_symbol_probabilities_sum_to_one_and_training_helps():
    rng = np.random.default_rng(0)
    word = np.tile(np.array([1, 2, 3, 4], np.uint8), 3000)
    noise = np.full(M.SYMBOLS, 1e-6) + np.bincount(word, minlength=M.SYMBOLS)
    net = M.Network(noise / noise.sum())
    ctx = M.contexts(word, np.array([len(word)]))
    assert ctx[5].tolist() == [1, 4, 3, 2] and ctx[0].tolist() == [0] * M.CONTEXT
    before = net.log10(ctx, word).mean()
    for a in range(0, len(word), 500):
        net.step(ctx[a : a + 500], word[a : a + 500], rng)
    assert net.log10(ctx, word).mean() > before
    one = np.repeat(ctx[7:8], M.SYMBOLS, 0)
    assert abs((10 ** net.log10(one, np.arange(M.SYMBOLS))).sum() - 1) < 1e-5
    assert np.array_equal(M.Network(net.noise, seed=1).unpack(net.pack()).log10(ctx[:9], word[:9]), net.log10(ctx[:9], word[:9]))


def test_without_rows_or_training_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert M.score(none).collect() == []
    out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = M.score(spark.createDataFrame([(out, "a b")], "doc_id long, text string")).collect()[0]
    assert tuple(row)[:6] == (out, True, 3, 0, 0, 0.0) and math.isfinite(row.score)


def test_default_trains_on_every_position(spark):
    df = spark.createDataFrame(_docs(), "doc_id long, text string").coalesce(1)
    kept = lambda rows: sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.score, r.held_out, r.base_score) for r in rows.collect()))
    got, whole, part = kept(M.score(df)), kept(M.score(df, stride=1)), kept(M.score(df, stride=8))
    assert np.allclose([r[3] for r in got], [r[3] for r in whole]) and not np.allclose([r[3] for r in got], [r[3] for r in part])
    held = [r for r in got if r[4]]
    assert sum(r[3] for r in held) > sum(r[5] for r in held)


def test_members_are_told_apart_by_context_and_sum_to_one():
    """Words a and b of one class, each always after its own head word."""
    rng = np.random.default_rng(0)
    a, b = M.SYMBOLS, M.SYMBOLS + 1
    word = np.where(rng.random(20000) < 0.5, 1, 2)
    word = np.stack([word, np.where(word == 1, a, b)], 1).ravel().astype(np.uint16)
    noise = np.full(M.SYMBOLS, 1e-6)
    noise[[1, 2, 1 + M.HEAD + 5]] += [0.25, 0.25, 0.5]
    net = M.Network(noise / noise.sum(), np.array([5, 5]), np.concatenate([np.ones(M.CLASSES), [10000.0, 10000.0]]))
    ctx = M.contexts(word, np.array([len(word)]))
    before = net.log10(ctx, word)[1::2].mean()
    for i in range(0, len(word), 500):
        net.step(ctx[i : i + 500], word[i : i + 500], rng)
    assert net.log10(ctx, word)[1::2].mean() > max(before, math.log10(0.6))  # by count share alone at most 1/2
    codes = np.arange(M.SYMBOLS + 2)
    assert abs((10 ** net.log10(np.repeat(ctx[7:8], len(codes), 0), codes)).sum() - 1) < 1e-5
    assert np.array_equal(M.Network(net.noise, np.array([5, 5]), seed=1).unpack(net.pack()).q2, net.q2)


def test_vocabulary_grows_with_the_corpus(spark, monkeypatch):
    """All words of a text with 400 equally frequent ones are outcomes and contexts of their own."""
    ws = [f"{chr(97 + i % 20)}{chr(97 + i // 20)}-{i}" for i in range(400)]
    docs = [(d, " ".join(ws[(37 * d + j) % 400] for j in range(200))) for d in range(600)]
    seen, train = [], M.train
    monkeypatch.setattr(M, "train", lambda *a: seen.append(len(a[2])) or train(*a))
    rows = M.score(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).where("held_out").collect()
    assert seen == [400] and sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert M._least(120000) == 87 and M._least(100 * 120000) > 3 * M._least(120000)


@pytest.mark.parametrize("large", [1, 40])
def test_shares_are_made_in_one_room(large):
    """Small scores are not shifted, those beyond 32 bits are; both are the shares of 64 bits."""
    rng = np.random.default_rng(large)
    r, q = (large * rng.normal(0, 1, (n, 17)).astype(np.float32) for n in (100, 256))
    own, room = rng.integers(0, 256, 100), np.empty(1024 * 256, np.float32)
    x = r.astype(float) @ q.T.astype(float)
    top = x.max(1, keepdims=True)
    want = (x - top)[np.arange(100), own] - np.log(np.exp(x - top).sum(1))
    room[:] = -1
    got = M._log_shares(r, q, own, room)
    assert np.allclose(got, want, rtol=1e-5, atol=1e-5) and (room[: 100 * 256] >= 0).all() and (room[100 * 256 :] == -1).all()
