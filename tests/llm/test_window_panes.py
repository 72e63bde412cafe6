import math
import random
import zlib
from datetime import datetime, timedelta

import pytest

from lensaudit.llm import common
from lensaudit.llm import window_panes as W

H = W.HOUR
ROWS = "batch long, click_id long, kind string, at long, cents long"


def slow(rows, batches):
    """Records by one row at a time."""
    out, panes, w = [], {}, -math.inf
    for b in range(batches):
        new = [r for r in rows if r[0] == b]
        old = dict(panes)
        for _, click, kind, at, cents in new:
            hour = at // H
            if w >= (hour + 1) * H + W.CLOSED:
                out.append((b, hour, click, 1, cents, "late", kind))
                continue
            n, c, e = panes.get((kind, hour), (0, 0, False))
            panes[kind, hour] = (n + 1, c + cents, e)
        for (kind, hour), (n, c, e) in list(panes.items()):
            end = (hour + 1) * H
            if not e and w >= end + W.DUE:
                out.append((b, hour, -1, n, c, "emit", kind))
            elif e and old.get((kind, hour)) != (n, c, e):
                out += [(b, hour, -1, *old[kind, hour][:2], "retract", kind), (b, hour, -1, n, c, "replace", kind)]
            elif not e and b == batches - 1:
                out.append((b, hour, -1, n, c, "final", kind))
            panes[kind, hour] = (n, c, e or w >= end + W.DUE)
            if w >= end + W.CLOSED:
                del panes[kind, hour]
        w = max([w, *(r[3] for r in new)])
    return out


def records(spark, rows, batches, **kw):
    df = spark.createDataFrame(rows, ROWS)
    return sorted(map(repr, map(tuple, W.run(df, common.work_dir(spark, "panes-test"), batches, **kw).collect())))


def test_equals_row_by_row(spark):
    """An empty batch, negative hours, corrections, late rows, a pane with most of the rows."""
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        b = rng.choice([0, 1, 1, 2, 4])
        at = b * 30 * H + rng.randrange(-200 * H, 20 * H) if rng.random() < 0.6 else 5 * H + rng.randrange(H)
        rows.append((b, i, rng.choice(["view", "view", "none", "é"]), at, rng.randrange(-500, 10_000)))
    rows += [(1, None, "view", -500 * H, 7), (2, 5, "view", 5 * H, 0), (2, 5, "view", 5 * H, 0)]  # a null id, repeated rows
    want = slow(rows, 5)
    assert {r[5] for r in want} == {"late", "emit", "retract", "replace", "final"} and any(r[1] < 0 for r in want)
    assert records(spark, rows, 5, shards=3) == sorted(map(repr, want))


def test_totals_of_zero_rows_and_no_rows(spark):
    assert records(spark, [], 2, shards=2) == []
    rows = [(0, 1, "a", 0, 0), (1, 2, "a", 40 * H, 0)]
    assert records(spark, rows, 3, shards=2) == sorted(map(repr, slow(rows, 3)))


def test_a_shard_holds_panes_between_flushes(spark, monkeypatch):
    monkeypatch.setattr(W, "HELD", 5)
    rows = [(b, 100 * b + i, f"k{i % 9}", (i * 7 % 50) * H + b * 60 * H, i) for b in range(3) for i in range(100)]
    assert records(spark, rows, 3, shards=4) == sorted(map(repr, slow(rows, 3)))


def test_cut(spark):
    t = datetime(2024, 1, 2, 3, 4, 5, 678)
    rows = [(i, t - timedelta(days=i % 5, hours=i), t + timedelta(hours=i), ["view", None][i % 2], 0.005 * i, "x") for i in range(100)]
    rows += rows[:10] + [(200, None, t, "view", 1.0, "x"), (201, t, None, "view", None, "x"), (None, t, t, "view", math.nan, "x"), (202, t, t, "v", math.inf, "x"), (203, t, t, "v", -0.125, "x"), (204, t, t, "v", 1e300, "x")]
    df = spark.createDataFrame(rows, "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, kind string, value double, batch string")
    got = {r.click_id: tuple(r) for r in W.cut(df, 8).collect()}
    epoch = datetime(1970, 1, 1)
    assert set(got) == {*range(100), 201, None, 202, 203, 204}
    for k, ts, arrived, kind, value, _ in rows[:100] + rows[111:]:
        d = ((arrived or ts) - epoch).days
        code = zlib.crc32(str(k).encode() if k is not None else b"") % 30
        cents = math.floor(100 * value + 0.5) if value is not None and math.isfinite(value) and abs(value) < 9e16 else 0
        assert got[k] == (min(7, d % 8 + max(0, code - 23)), k, kind or "none", (ts - epoch) // timedelta(microseconds=1) - (d - d % 8) * W.DAY, cents)
    assert W.cut(df.where("false")).collect() == []


def test_settings_are_put_back(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key), spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(Exception):
        W.run(spark.createDataFrame([(0, 1, "a", 0, 0)], ROWS), "file:///proc/nowhere", 1)
    assert (spark.conf.get(key), spark.conf.get("spark.sql.shuffle.partitions")) == before
