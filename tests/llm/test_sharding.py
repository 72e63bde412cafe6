import zlib
from bisect import bisect_left, insort
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from lensaudit.llm import fit
from lensaudit.llm.sharding import assign_shards


@given(st.lists(st.tuples(st.booleans(), st.integers(0, 50)), max_size=200))
def test_tree_equals_a_sorted_list(ops):
    tree, kept = fit.CapacityTree(), []
    for i, (add, x) in enumerate(ops):
        if add or not kept:
            tree.insert((x, i))
            insort(kept, (x, i))
        else:
            tree.remove(kept.pop(x % len(kept)))
        at = bisect_left(kept, (x, -1))
        assert tree.ceiling((x, -1)) == (kept[at] if at < len(kept) else None) and len(tree) == len(kept)


def _one_by_one(hist, capacity):
    rem = []
    for size, count in sorted(hist, reverse=True):
        for _ in range(count):
            fits = [(r, b) for b, r in enumerate(rem) if r >= size]
            if fits:
                rem[min(fits)[1]] -= size
            else:
                rem.append(max(capacity, size) - size)
    return rem


@settings(max_examples=60)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), max_size=8), st.integers(5, 60))
def test_fill_equals_best_fit_item_by_item(hist, capacity):
    placed, bins = fit.fill(list(hist.items()), capacity)
    used = Counter()
    for p in placed:
        used[p.bin] += p.size * (p.hi - p.lo)
    want = _one_by_one(list(hist.items()), capacity)
    assert bins == len(want) and sum(p.hi - p.lo for p in placed) == sum(hist.values())
    big = [max(capacity, s) for s, c in sorted(hist.items(), reverse=True) for _ in range(c)]
    assert all(used[b] <= max(capacity, max(big, default=0)) for b in used)


@settings(max_examples=60)
@given(st.dictionaries(st.integers(1, 500), st.integers(1, 30), min_size=1, max_size=30))
def test_even_places_every_rank_once(hist):
    seen = Counter()
    for p in fit.even(list(hist.items()), 8):
        assert 0 <= p.bin < 8
        for r in range(p.lo, p.hi):
            seen[p.size, r] += 1
    assert seen == {(s, r): 1 for s, c in hist.items() for r in range(c)}


def _check(spark, rows):
    df = spark.createDataFrame([(k, t, "z") for k, t in rows], "doc_id long, text string, shard string")
    got = assign_shards(df).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in rows), key=repr)
    groups = {}
    for k, t in rows:
        groups.setdefault(t or "", []).append(k)
    where = {}
    for r in got:
        where.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert all(len(s) == 1 for s in where.values()) and {r.law for r in got} <= {"bytes"} and {r.grown_shard for r in got} <= {None}
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    bytes_ = Counter()
    for r in got:
        bytes_[r.shard] += r.size
    return bytes_


def test_shards_are_even_and_groups_whole(spark):
    rows = [(i, "word " * (i % 37)) for i in range(400)] + [(1000 + i, f"text {i} " * (i % 50)) for i in range(600)] + [(None, None), (None, ""), (5, "dup"), (5, "dup")]
    b = _check(spark, rows)
    assert set(b) <= set(range(8)) and max(b.values()) - min(b.values()) < 0.2 * sum(b.values()) / 8


def test_a_group_over_the_share_has_its_own_shard(spark):
    b = _check(spark, [(i, "hot " * 30) for i in range(300)] + [(1000 + i, f"cold {i} " * 5) for i in range(300)])
    rest = sorted(b.values())[:-1]
    assert len(b) == 8 and max(rest) - min(rest) <= 60


def test_few_rows_and_none(spark):
    assert sum(_check(spark, [(1, "a"), (2, None)]).values()) == 3
    assert assign_shards(spark.createDataFrame([], "doc_id long, text string")).collect() == []
