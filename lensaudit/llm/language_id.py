"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For each bit a binary classifier over letter n-grams tells
the languages that have the bit from those that do not; the languages are then compared by the
loss of their codewords, each bit weighed by how well it is predicted. Codewords are far
apart, so some bits may be wrong; where two languages come close, the row is marked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BATCH_BYTES = 1_000_000
#: Characters of a text that are read at once; n-grams over such a cut are not counted.
PIECE = 1_000_000
ORDERS = (1, 2, 3, 4)
#: Hashed n-grams of each order.
SLOTS = 1 << 15
BLOCK = 1 << 12
#: Labelled rows that the bits' classifiers are weighed on: those first by a hash. Counts of n-grams use all.
FIT_ROWS = 20_000
#: A second language that is so near in probability makes a row ambiguous.
NEAR = 0.2
NONE = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngrams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the slots of all n-grams and the text each is from. Lower-cased letters
    count, and one space for whatever stands between words."""
    texts = [t.lower() for t in texts]
    raw = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts)))
    letter = _letters()[raw]
    keep = letter.copy()
    keep[:-1] |= letter[1:] | (owner[1:] != owner[:-1])  # of what stands between words, the last place
    keep[-1:] = True
    code = np.where(letter, raw, 32)[keep] * np.uint32(2_654_435_761)
    word, owner = letter[keep], owner[keep]
    h = np.zeros(len(code), np.uint32)
    for k in ORDERS:
        n = max(0, len(code) - k + 1)
        h = h[:n] * np.uint32(0x01000193) + code[k - 1 :]
        fits = owner[:n] == owner[k - 1 :]
        if k == 1:
            fits = fits & word
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        slot = (mixed >> np.uint32(32 - SLOTS.bit_length() + 1)).astype(np.int32) + (k - 1) * SLOTS
        yield slot[fits], owner[:n][fits]


def _pieces(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Texts cut into pieces, and the text of each piece."""
    cut = [(i, t[a : a + PIECE]) for i, t in enumerate(texts) if t for a in range(0, len(t), PIECE)]
    return [t for _, t in cut], np.fromiter((i for i, _ in cut), np.int32, len(cut))


def _portions(texts: list[str | None]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Pieces of about PIECE characters together."""
    pieces, owner = _pieces(texts)
    a = n = 0
    for z, t in enumerate(pieces):
        n += len(t)
        if n >= PIECE:
            yield pieces[a : z + 1], owner[a : z + 1]
            a, n = z + 1, 0
    if a < len(pieces):
        yield pieces[a:], owner[a:]


def codewords(n: int) -> np.ndarray:
    """A word of +1 and -1 for each of ``n`` languages: every way to part them up to five, beyond
    that the most distant of 300 drawn ones (the same for every run)."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 5:
        return np.array([(1, *rest) for rest in product((1, -1), repeat=n - 1)][1:], float).T
    rng, best, far = np.random.default_rng(n), None, (-1, -1)
    bits = int(np.ceil(10 * np.log2(n)))
    for _ in range(300):
        words = np.stack([rng.permutation(np.where(np.arange(n) % 2, 1.0, -1.0)) for _ in range(bits)], axis=1)
        apart = (bits - words @ words.T) / 2
        np.fill_diagonal(apart, bits)
        cols = np.abs(words.T @ words) - n * np.eye(bits)
        if (rank := (apart.min(), -cols.max())) > far:
            best, far = words, rank
    return best


@dataclass
class Codes:
    """Languages, their codewords, the weight of each slot for each bit, and how a bit's evidence
    of each order makes a logit (the last row is a constant); ``trust`` weighs the bits."""

    langs: list[str]
    words: np.ndarray
    slots: np.ndarray
    mix: np.ndarray
    trust: np.ndarray

    def evidence(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(rows, orders, bits) of evidence, and whether a row has a letter."""
        sums = np.zeros((len(texts), len(ORDERS), self.words.shape[1]))
        counts = np.zeros((len(texts), len(ORDERS)))
        for pieces, owner in _portions(texts):
            for o, (slot, mine) in enumerate(ngrams(pieces)):
                if len(slot):
                    starts = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
                    rows = owner[mine[starts]]
                    np.add.at(sums, (rows, o), np.add.reduceat(self.slots[slot], starts, axis=0, dtype=np.float64))
                    np.add.at(counts, (rows, o), np.diff(np.r_[starts, len(slot)]))
        return sums / np.maximum(counts, 1)[:, :, None] * np.log1p(counts)[:, :, None], counts[:, 0] > 0

    def probabilities(self, evidence: np.ndarray) -> np.ndarray:
        """Of each language for each row, from the weighted losses of the codewords."""
        bits = self.words.shape[1]
        if not bits:
            return np.ones((len(evidence), len(self.langs)))
        z = np.einsum("rob,ob->rb", evidence, self.mix[:-1]) + self.mix[-1]
        loss = np.logaddexp(0, -z[:, None, :] * self.words[None]) @ self.trust
        p = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * np.log2(len(self.langs)) / bits)
        return p / p.sum(axis=1, keepdims=True)


def held_out(col: str = "doc_id"):
    """True for rows nothing may be learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _slots(counts: dict[str, np.ndarray], langs: list[str], words: np.ndarray) -> np.ndarray:
    """Log odds of each slot for each bit: languages count alike on both sides."""
    share = np.zeros((len(langs), len(ORDERS) * SLOTS))
    for i, lang in enumerate(langs):
        c = counts.get(lang, np.zeros(share.shape[1])).reshape(len(ORDERS), SLOTS) + 0.5
        share[i] = (c / c.sum(axis=1, keepdims=True)).ravel()
    out = np.zeros((share.shape[1], words.shape[1]), np.float32)
    for b in range(words.shape[1]):
        out[:, b] = np.log(share[words[:, b] > 0].mean(axis=0)) - np.log(share[words[:, b] < 0].mean(axis=0))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights of columns and a constant by Newton steps; labels are +1 and -1. Columns are scaled
    to one size and held small, so that where labels part cleanly, mixed rows stay near the middle."""
    size = np.sqrt((x**2).mean(axis=0)) + 1e-9
    x = np.c_[x / size, np.ones(len(x))]
    hold = np.r_[np.full(x.shape[1] - 1, ridge), 1e-3]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(hold), x.T @ (p - (y > 0)) + hold * w)
        w = w - step * min(1, 3 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w / np.r_[size, 1]


def _counted(docs: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """Counts of n-grams of each language and half of the labelled rows, and under ``("", 2)``
    how many rows these were. Tasks add up their rows, then blocks of slots are added up."""

    def count(batches):
        held: dict[tuple[str, int], np.ndarray] = {}
        rows = 0
        for b in common.batched(batches, "text", BATCH_BYTES):
            rows += b.num_rows
            names = list(zip(b.column("lang").to_pylist(), b.column("half").to_pylist()))
            for pieces, owner in _portions(b.column("text").to_pylist()):
                keys = sorted({names[i] for i in owner.tolist()})
                which = np.array([keys.index(names[i]) for i in owner.tolist()])
                for slot, mine in ngrams(pieces):
                    of = which[mine]
                    for k, key in enumerate(keys):
                        if (got := slot[of == k]).size:
                            held.setdefault(key, np.zeros(len(ORDERS) * SLOTS, np.int64))
                            held[key] += np.bincount(got, minlength=len(ORDERS) * SLOTS)
        out = [(lang, half, a // BLOCK, c[a : a + BLOCK]) for (lang, half), c in held.items() for a in range(0, len(c), BLOCK) if c[a : a + BLOCK].any()]
        yield from _blocks(out + [("", 2, 0, np.array([rows], np.int64))])

    def add(batches):
        held: dict[tuple[str, int, int], np.ndarray] = {}
        for b in batches:
            for lang, half, block, counts in zip(b.column("lang").to_pylist(), b.column("half").to_pylist(), b.column("block").to_pylist(), b.column("counts")):
                c = counts.values.to_numpy()
                held[lang, half, block] = held[lang, half, block] + c if (lang, half, block) in held else c.copy()
        yield from _blocks([(*k, c) for k, c in held.items()])

    schema = "lang string, half int, block int, counts array<long>"
    parts = docs.mapInArrow(count, schema).repartition("lang", "half", "block").mapInArrow(add, schema)
    got: dict[tuple[str, int], np.ndarray] = {}
    for b in parts.toArrow().to_batches():
        for lang, half, block, counts in zip(b.column("lang").to_pylist(), b.column("half").to_pylist(), b.column("block").to_pylist(), b.column("counts")):
            c = counts.values.to_numpy()
            whole = got.setdefault((lang, half), np.zeros(1 if half == 2 else len(ORDERS) * SLOTS, np.int64))
            whole[block * BLOCK : block * BLOCK + len(c)] += c
    return got


def _blocks(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(rows), 64):
        lang, half, block, counts = zip(*rows[a : a + 64])
        yield pa.RecordBatch.from_pydict({"lang": pa.array(lang, pa.string()), "half": pa.array(half, pa.int32()), "block": pa.array(block, pa.int32()), "counts": pa.array(counts, pa.list_(pa.int64()))})


def fit(docs: DataFrame, rows: int = FIT_ROWS) -> Codes:
    """Codes from the documents that are not held out and have a language.

    Counts of n-grams are of all of them. How much the orders and bits weigh is fitted on at most
    ``rows`` different rows (those first by a hash), each judged by the counts of the other half, so that
    no row is judged by its own n-grams. The driver holds counts of each language, not of rows.
    """
    spark = docs.sparkSession
    half = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) / 4).cast("long") % 2
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), half.cast("int").alias("half"), F.xxhash64(F.col("doc_id"), F.col("text"), F.col("lang")).alias("key"))
    counts = _counted(known.select("lang", "half", "text"))
    n = int(counts.pop(("", 2), np.zeros(1))[0])
    langs = sorted({lang for lang, _ in counts})
    words = codewords(len(langs))
    bits = words.shape[1]
    both = {lang: counts.get((lang, 0), 0) + counts.get((lang, 1), 0) for lang in langs}
    model = Codes(langs, words, _slots(both, langs, words), np.ones((len(ORDERS) + 1, bits)), np.ones(bits))
    model.mix[-1] = 0
    if not bits:
        return model
    # The first rows by hash are among the lowest hashes; only those are sorted.
    few = F.col("key") < int(-(1 << 63) + min(1.0, 4 * rows / max(1, n)) * ((1 << 64) - 1)) if n > 4 * rows else F.lit(True)
    chosen = known.where(few).select("key").distinct().orderBy("key").limit(rows)
    sample = known.where(few).join(F.broadcast(chosen), "key")  # at most ``rows`` keys
    halves = [Codes(langs, words, _slots({k: v for (k, h), v in counts.items() if h == 1 - i}, langs, words), model.mix, model.trust) for i in (0, 1)]
    held = spark.sparkContext.broadcast(halves)

    def judge(batches):
        for b in common.batched(batches, "text", BATCH_BYTES):
            texts, side = b.column("text").to_pylist(), b.column("half").to_numpy()
            x, seen = (np.where((side == 0).reshape(-1, *[1] * (a.ndim - 1)), a, c) for a, c in zip(*(m.evidence(texts) for m in held.value)))
            yield pa.RecordBatch.from_pydict({"key": b.column("key"), "lang": b.column("lang"), "x": pa.array(list(x.reshape(len(x), -1)), pa.list_(pa.float64())), "seen": pa.array(seen)})

    one = sample.mapInArrow(judge, "key long, lang string, x array<double>, seen boolean").where("seen").groupBy("key").agg(F.min(F.struct("lang", "x")).alias("r"))
    got = one.select("key", "r.*").toArrow().sort_by("key")
    x = np.array(got["x"].to_pylist(), float).reshape(-1, len(ORDERS), bits)
    at = {lang: i for i, lang in enumerate(langs)}
    y = words[[at[k] for k in got["lang"].to_pylist()]].reshape(-1, bits)
    for b in range(bits):
        if len(y) and -len(y) < y[:, b].sum() < len(y):
            model.mix[:, b] = _logistic(x[:, :, b], y[:, b])
            wrong = ((x[:, :, b] @ model.mix[:-1, b] + model.mix[-1, b]) * y[:, b] <= 0).sum()
            miss = (wrong + 1) / (len(y) + 2)
            model.trust[b] = max(0.1, np.log((1 - miss) / miss))
    model.trust /= model.trust.mean()
    return model


def identify(docs: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, runner_up and ambiguous of each row.

    Learned from text and lang of rows that are not held out; predicted from whole texts alone. Null,
    empty and letterless texts are ``und`` with score 0, as all are where nothing was learned; very
    long texts are read in pieces. score is the probability of lang_pred; ambiguous where the
    runner-up comes within NEAR of it. Ties go to the language that sorts first. Repeated rows
    get the same answer; a null doc_id is not held out. An empty table gives an empty result;
    other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, rows))

    def run(batches):
        m = model.value
        names = np.array([*m.langs, NONE], object)
        for b in common.batched(batches, "text", BATCH_BYTES):
            evidence, seen = m.evidence(b.column("text").to_pylist())
            p = m.probabilities(evidence)
            p = np.c_[p, np.zeros((len(p), 2))]  # columns that stand for no language
            order = np.argsort(-p, axis=1, kind="stable")
            r = np.arange(len(p))
            best = np.where(seen & bool(m.langs), order[:, 0], len(m.langs))
            score, second = p[r, best], p[r, order[:, 1]]
            known = best < len(m.langs)
            runner = np.where(known & (order[:, 1] < len(m.langs)), names[np.minimum(order[:, 1], len(m.langs))], None)
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "lang_pred": pa.array(names[best], pa.string()), "score": pa.array(np.where(known, score, 0.0)),
                "runner_up": pa.array(runner, pa.string()), "ambiguous": pa.array(known & (score - second < NEAR)),
            })

    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    return rows_.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, runner_up string, ambiguous boolean")
