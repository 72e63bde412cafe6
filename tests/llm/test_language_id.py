import random
import zlib

import numpy as np
import pytest

from lensaudit.llm import language_id as L

SCHEMA = "doc_id long, text string, lang string"
SOUNDS = {"aa": "ka ri to mu ne sha", "bb": "grun pfel schta bo ik", "cc": "çé oui eau la que", "dd": "жа ке ло ми по", "ee": "x y z w vv", "ff": "qo qi pa ta la", "gg": "llo ñe rra mos"}


def prose(rng, lang, words):
    parts = SOUNDS[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(words)).capitalize() + "."


def made_up(n, langs, seed=1):
    rng = random.Random(seed)
    return [(i, prose(rng, lang := rng.choice(langs), rng.randrange(3, 60)), lang) for i in range(n)]


def slow_grams(text):
    """Letters lower-cased; a space before, between and after words; n-grams as texts."""
    words, out = "".join(c if c.isalpha() else " " for c in text.lower()).split(), []
    if not words:
        return []
    line = " " + " ".join(words) + " "
    for k in L.ORDERS:
        out += [line[i : i + k] for i in range(len(line) - k + 1) if k > 1 or line[i] != " "]
    return out


def test_ngrams_are_those_of_a_slow_reading():
    texts = ["", "a", "Ab  c", "..x,y..", "Été 12 Ω", "\n\t", "ab", "İx", "1", "a" * 50]
    got = [[] for _ in texts]
    for slot, owner in L.ngrams(texts):
        for s, o in zip(slot.tolist(), owner.tolist()):
            got[o].append(s)
    seen = {}
    for text, slots in zip(texts, got):
        want = slow_grams(text)
        assert len(want) == len(slots)
        for g, s in zip(want, slots):  # one slot for one n-gram, in its order's part
            assert seen.setdefault(g, s) == s and s // L.SLOTS == len(g) - 1
    assert len(set(seen.values())) > 0.99 * len(seen)


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 12, 40])
def test_codewords_are_apart(n):
    words = L.codewords(n)
    apart = (words.shape[1] - words @ words.T) / 2
    assert min(apart[i, j] for i in range(n) for j in range(i)) >= max(1, words.shape[1] // 4)
    assert (np.abs(words.sum(axis=0)) < n).all() and np.array_equal(words, L.codewords(n))


def test_probabilities_by_hand():
    words = L.codewords(3)
    m = L.Codes(["a", "b", "c"], words, np.zeros((1, 3), np.float32), np.r_[np.ones((4, 3)), np.full((1, 3), 0.1)], np.array([1.0, 0.5, 1.5]))
    e = np.random.default_rng(0).normal(size=(6, 4, 3))
    for row, p in zip(e, m.probabilities(e)):
        z = row.sum(axis=0) + 0.1
        raw = [np.exp(-sum(t * np.log(1 + np.exp(-c * x)) for t, c, x in zip(m.trust, word, z)) * np.log2(3) / 3) for word in words]
        assert np.allclose(p, np.array(raw) / sum(raw))


@pytest.mark.parametrize("langs", [list(SOUNDS), ["aa", "bb"], ["cc", "dd", "ee", "ff"]])
def test_held_out_accuracy_and_no_use_of_held_out_labels(spark, langs):
    rows = made_up(700, langs)
    got = {r.doc_id: r for r in L.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    out = [k for k, r in got.items() if r.held_out]
    assert set(out) == {k for k, *_ in rows if zlib.crc32(str(k).encode()) % 4 == 2}
    assert np.mean([got[k].lang_pred == rows[k][2] for k in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    other = [(k, t, "zz" if got[k].held_out else lang) for k, t, lang in rows]
    assert {r.doc_id: tuple(r) for r in L.identify(spark.createDataFrame(other, SCHEMA).repartition(5)).collect()} == {k: tuple(r) for k, r in got.items()}


def test_mixed_texts_are_ambiguous_and_whole_texts_count(spark):
    rng = random.Random(4)
    rows = made_up(400, ["aa", "bb", "cc"])
    odd = [k for k in range(5000, 6000) if zlib.crc32(str(k).encode()) % 4 == 2]
    rows += [(odd[0], prose(rng, "aa", 50) + " " + prose(rng, "bb", 800), "aa")]  # begins in another language
    rows += [(odd[1 + i], prose(rng, "aa", 16 + i) + " " + prose(rng, "bb", 40 - i), None) for i in range(20)]
    got = {r.doc_id: r for r in L.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[odd[0]].lang_pred == "bb"
    assert {got[odd[1 + i]].lang_pred for i in range(20)} <= {"aa", "bb"}
    assert any(got[odd[1 + i]].ambiguous and {got[odd[1 + i]].lang_pred, got[odd[1 + i]].runner_up} == {"aa", "bb"} for i in range(20))
    assert not any(r.ambiguous for k, r in got.items() if k < 400 and len(rows[k][1]) > 60)


def test_odd_rows(spark, monkeypatch):
    rng = random.Random(9)
    rows = made_up(200, ["aa", "bb"])
    long_text = prose(rng, "bb", 400_000)
    rows += [(300, None, "aa"), (301, "", "aa"), (302, "12 -- ?", "bb"), (303, long_text, None), (303, long_text, None), (None, prose(rng, "aa", 20), None), (None, None, None)]
    df = spark.createDataFrame([(*r, 0.5, "x", 1) for r in rows], SCHEMA + ", score double, key string, half int")
    monkeypatch.setattr(L, "PIECE", 10_000)
    got = L.identify(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert all((by[k][0].lang_pred, by[k][0].score, by[k][0].runner_up, by[k][0].ambiguous) == ("und", 0.0, None, False) for k in (300, 301, 302))
    assert by[303][0] == by[303][1] and by[303][0].lang_pred == "bb"
    assert sorted(r.lang_pred for r in by[None]) == ["aa", "und"] and not by[None][0].held_out


def test_nothing_and_one_language_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, None, "aa")], SCHEMA)
    assert {(r.lang_pred, r.score) for r in L.identify(df).collect()} == {("und", 0.0)}
    one = spark.createDataFrame([(i, "abc def", "aa") for i in range(8)] + [(9, "--", "bb")], SCHEMA)
    assert {r.lang_pred: r.score for r in L.identify(one).collect()} == {"aa": 1.0, "und": 0.0}
    assert L.identify(df.where("false")).collect() == []
