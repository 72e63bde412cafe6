import heapq
import random

import pytest

from lensaudit.llm import conversation_repair as R

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """Least (cost, audit, texts) by a search over (turns done, initials so far); rows: (role, text, must_go, truncated)."""
    todo, done = [(0, "", (), 0, "")], set()
    while todo:
        cost, audit, texts, i, last = heapq.heappop(todo)
        if (i, last) in done:
            continue
        if i == len(rows) and last in ("", "a"):
            return cost, audit, texts
        done.add((i, last))
        fits = lambda k: {"s": last == "", "u": last != "u", "a": last == "u"}.get(k, False)
        for k, role in (("u", "user"), ("a", "assistant")):
            if fits(k):
                heapq.heappush(todo, (cost + 2, audit + "I", (*texts, role + ":"), i, k))
        if i < len(rows):
            role, text, must_go, truncated = rows[i]
            heapq.heappush(todo, (cost + 3, audit + "D", texts, i + 1, last))
            if not must_go:
                if fits(role[:1]):
                    heapq.heappush(todo, (cost + truncated, audit + "K", (*texts, f"{role}:{text}"), i + 1, role[:1]))
                for k, to in (("u", "user"), ("a", "assistant")):
                    if fits(k):
                        heapq.heappush(todo, (cost + 2 + truncated, audit + "R", (*texts, f"{to}:{text}"), i + 1, k))


def slow(turns):
    turns = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in turns), key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
    seen, rows, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    for _, role, text in turns:
        body = text.rstrip(R.SPACE)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        rows.append((role, text, fault in ("blank", "duplicate"), int(fault == "truncated")))
    counts["illegal"] = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    known = [t for t, *_ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    cost, audit, texts = cheapest(rows)
    return (gaps, *counts.values(), cost, audit, "\n".join(texts))


def made_up(n, seed, longest=9):
    rng, out = random.Random(seed), []
    for c in range(n):
        for i in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "no end", "", " \t\n", None, "Why?\x0b", "é", "a.b", "user:\nx."])
            out.append((c, rng.choice([i, i, i, 3, None]), role, text))
    rng.shuffle(out)
    return out


def by_conv(rows):
    out = {}
    for c, *rest in rows:
        out.setdefault(c, []).append(rest)
    return out


@pytest.mark.parametrize("chunk", [2, 256])
def test_equals_a_search(spark, monkeypatch, chunk):
    """Also where edits pass from chunk to chunk."""
    monkeypatch.setattr(R, "CHUNK", chunk)
    rows = made_up(250, seed=chunk) + [(None, 0, "user", "A."), (None, 1, "user", "B")]
    got = {r[0]: tuple(r[1:]) for r in R.repair(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == {c: slow(x) for c, x in by_conv(rows).items()}
    assert any(r[5] > 8 for r in got.values()) and {"K", "R", "D", "I"} <= set("".join(r[6] for r in got.values()))


def test_long_conversation(spark):
    rng = random.Random(5)
    rows = [(1, i, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "open", f"{i}."])) for i in range(1500)] + [(2, 0, "user", "long " * 500_000)]
    got = {r[0]: tuple(r[1:]) for r in R.repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {c: slow(x) for c, x in by_conv(rows).items()}


def test_conversations_without_turns_and_empty_tables(spark):
    rows = [(1, 0, "user", "A.", True, "x"), (2, 0, "user", "A.", True, "x"), (2, 4, "user", "B.", False, "y"), (2, 6, "assistant", "C.", None, "y")]
    df = spark.createDataFrame(rows, SCHEMA + ", gone boolean, repaired string")
    got = {r.conv_id: r for r in R.repair(df, gone="gone").collect()}
    assert tuple(got[1]) == (1, 0, 0, 0, 0, 0, 0, "", "")
    assert tuple(got[2]) == (2, 1, 0, 0, 0, 0, 0, "KK", "user:B.\nassistant:C.")
    assert R.repair(df.where("false")).collect() == [] == R.damage(df.where("false")).collect()


def test_damage(spark):
    import zlib

    rows = [(c, t, r, x) for c in (*range(60), None) for t, r, x in ((0, "system", "Be. kind!"), (1, None, "Why?"), (None, "assistant", None))]
    want = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r if r is not None else " ", x if x is not None else " "
        x = "" if k == 1 else "".join(q for q in x if q not in ".!?") if k == 2 else x
        want += [(c, t, "user" if k == 4 else r, x, k == 0)] * (2 if k == 3 else 1)
    assert len({w[4] for w in want}) == 2 and len(want) > len(rows)
    assert sorted(map(repr, map(tuple, R.damage(spark.createDataFrame(rows, SCHEMA)).collect()))) == sorted(map(repr, want))
