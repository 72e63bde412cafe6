import random
from collections import Counter
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lensaudit.llm import packing


@settings(max_examples=80)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 9), min_size=1, max_size=20))
def test_plan_is_whole_and_never_overfills(hist):
    caps = (16, 32, 64)
    used, seen = Counter(), Counter()
    spans = {}
    for r in packing.plan(list(hist.items()), caps):
        for rank in range(r.lo, r.hi):
            seen[r.size, rank] += 1
            b = r.bin + (rank - r.lo) // r.each
            at = r.offset + (rank - r.lo) % r.each * r.size
            used[b] += r.size
            spans.setdefault(b, []).append((at, at + r.size))
    assert seen == {(s, i): 1 for s, c in hist.items() for i in range(c)}
    for b, s in spans.items():  # pieces lie end to end from 0
        s.sort()
        assert s[0][0] == 0 and all(x[1] == y[0] for x, y in zip(s, s[1:])) and s[-1][1] == used[b] <= 64
    assert sorted(spans) == list(range(len(spans)))


def test_joint_choice_is_not_worse_than_the_largest_size_alone():
    hist = [(9, 5), (17, 3), (3, 4)]
    best = min(packing.best_fit(hist, s, (10, 20, 40), float)[0] for s in ((40,), (20, 40), (10, 40), (10, 20, 40)))
    runs = packing.plan(hist, (10, 20, 40))
    used = Counter()
    for r in runs:
        for rank in range(r.lo, r.hi):
            used[r.bin + (rank - r.lo) // r.each] += r.size
    assert sum(packing.downsize(u, (10, 20, 40)) for u in used.values()) == best


def test_documents_are_cut_placed_and_counted(spark):
    rows = [(i, "w " * (i * 7 % 300)) for i in range(200)] + [(None, None), (5, ""), (7, "x " * 5000), (7, "x " * 5000)]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, bin int")
    got = packing.pack(df, capacities=(64, 128, 256)).collect()
    total = Counter()
    for r in got:
        total[r.doc_id] += r.length
        assert r.start == r.piece * 256 and 0 < r.length <= 256 and r.offset + r.length <= r.used <= r.capacity
    want = Counter()
    for k, t in rows:
        want[k] += len((t or "").split()) + 1
    assert total == want
    for b in {r.bin for r in got}:
        mine = sorted((r.offset, r.length) for r in got if r.bin == b)
        assert mine[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(mine, mine[1:]))
        assert {r.capacity for r in got if r.bin == b} == {packing.downsize(sum(n for _, n in mine), (64, 128, 256))}


def test_length_column_and_empty_table(spark):
    df = spark.createDataFrame([(1, 10), (2, None), (3, 0), (4, 100)], "doc_id long, n long")
    assert sorted((r.doc_id, r.length) for r in packing.pack(df, (16, 64), length="n").collect()) == [(1, 10), (4, 36), (4, 64)]
    assert packing.pack(df.where("false"), (16, 64), length="n").collect() == []


def _one_by_one(sizes, opening, caps):
    """Best-fit-decreasing piece by piece: the bin with the least room that suffices, else a new one
    of the size that costs least for each token that equal pieces would fill."""
    bins = []  # [room, used]
    for n in sorted(sizes, reverse=True):
        fit = [b for b in bins if b[0] >= n]
        if not fit:
            cap = min((c for c in opening if c >= n), key=lambda c: (c / (c // n * n), c))
            bins.append([cap, 0])
            fit = [bins[-1]]
        b = min(fit, key=lambda x: x[0])
        b[0] -= n
        b[1] += n
    return sum(packing.downsize(used, caps) for _, used in bins), sorted(used for _, used in bins)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=40), st.sampled_from([(64,), (32, 64), (16, 32, 64), (24, 40, 64)]))
def test_best_fit_by_histogram_equals_best_fit_piece_by_piece(sizes, opening):
    caps = (16, 24, 32, 40, 64)
    total, runs = packing.best_fit(list(Counter(sizes).items()), opening, caps, float)
    used = Counter()
    for r in runs:
        for rank in range(r.lo, r.hi):
            used[r.bin + (rank - r.lo) // r.each] += r.size
    want, bins = _one_by_one(sizes, opening, caps)
    assert sorted(used.values()) == bins and total == want


def _least_cost(sizes, caps):
    """Of all ways to part the pieces into bins, the least sum of the smallest sizes that hold them."""
    best = float("inf")

    def place(i, bins):
        nonlocal best
        if i == len(sizes):
            best = min(best, sum(packing.downsize(b, caps) for b in bins))
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= max(caps):
                place(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best


def test_small_cases_against_the_optimum():
    rng, caps, ours, best = random.Random(2), (8, 16, 32), 0, 0
    for _ in range(60):
        sizes = [rng.randrange(1, 33) for _ in range(rng.randrange(1, 8))]
        used = Counter()
        for r in packing.plan(list(Counter(sizes).items()), caps):
            for rank in range(r.lo, r.hi):
                used[r.bin + (rank - r.lo) // r.each] += r.size
        got, least = sum(packing.downsize(u, caps) for u in used.values()), _least_cost(sizes, caps)
        assert least <= got <= 1.5 * least
        ours, best = ours + got, best + least
    assert ours <= 1.08 * best


def test_joint_choice_is_the_cheapest_of_all_sets():
    rng, caps = random.Random(4), (10, 20, 40)
    for _ in range(40):
        sizes = [rng.randrange(1, 41) for _ in range(rng.randrange(1, 30))]
        used = Counter()
        for r in packing.plan(list(Counter(sizes).items()), caps):
            for rank in range(r.lo, r.hi):
                used[r.bin + (rank - r.lo) // r.each] += r.size
        sets = [tuple(c for c, on in zip(caps, some) if on) for some in product((0, 1), (0, 1), (1,))]
        assert sum(packing.downsize(u, caps) for u in used.values()) == min(_one_by_one(sizes, s, caps)[0] for s in sets)


def test_sequences_hold_the_tokens_of_whole_documents(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["the", "cat", "Züge", "x1", "\n"]) for _ in range(rng.randrange(60)))) for i in range(80)]
    rows += [(None, None), (5, ""), (7, "word " * 3000), (7, "word " * 3000), (3, "<|endoftext|> a")]
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, ids int, bin string")
    caps = (32, 64, 128)
    got = packing.sequences(df, path, caps).collect()
    parts: dict = {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u2").tolist()
        assert len(ids) == r.used == sum(r.lengths) <= r.capacity == packing.downsize(r.used, caps)
        assert r.offsets == [sum(r.lengths[:i]) for i in range(len(r.lengths))]
        for k, start, n, at in zip(r.doc_ids, r.starts, r.lengths, r.offsets):
            parts.setdefault((k, start), []).append(tuple(ids[at : at + n]))
    want: dict = {}
    for k, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for start in range(0, len(ids), 128):
            want.setdefault((k, start), []).append(tuple(ids[start : start + 128]))
    assert {k: sorted(v) for k, v in parts.items()} == {k: sorted(v) for k, v in want.items()}
    flat = packing.pack(df, caps, tokenizer=path).collect()
    assert sorted(r.used for r in got) == sorted({r.bin: r.used for r in flat}.values())
    assert packing.sequences(df.where("false"), path, caps).collect() == []
