"""LM scoring: a log-bilinear neural model trained in numpy with noise-contrastive estimation.

Words are counted over the whole corpus without a dictionary in one place: documents are
encoded in chunks with a dictionary of their own, chunks send (hash, count) arrays by
ranges of the 64-bit hash, and get back the corpus counts of just their words.

The model predicts in two levels from the last CONTEXT words. The first has SYMBOLS
outcomes: the end of a text, the most frequent words, and classes of the remaining words by
their first two bytes. The second, within a class, has the class's members and one outcome
for its other words. Members are all words that occur at least sqrt(tokens) / MEMBERS times
in training, so the vocabulary grows with the corpus (as its square root at most, which
bounds what tasks hold); they are contexts of their own too. Other words share their
outcome by count, with a Good-Turing share for all words not seen in training. So token
probabilities sum to 1 over the known words and, for each class, one unknown word.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SYMBOLS, CLASSES, CONTEXT, WIDTH = 256, 64, 4, 16
HEAD = SYMBOLS - CLASSES - 1
#: Text in one chunk: its ids, words and counts are held in memory together.
CHUNK_BYTES = 16_000_000
#: Positions that train the network: every STRIDE-th of all training text (1: all), in batches.
STRIDE, BATCH, NOISE, RATE = 1, 4096, 64, 0.1
#: Words are members that occur sqrt(training tokens) / MEMBERS times; noise words of a class in a batch.
MEMBERS, INNER_NOISE = 4, 4
SCORE_BATCH, INNER_BATCH = 1024, 65536  # scores of the first stay in a core's cache
#: Scores within this need no shift before they are exponentials of 32 bits.
SAFE = 60


def held_out(col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _class(word: bytes) -> int:
    return zlib.crc32(word[:2]) % CLASSES


def encode(docs: DataFrame, uri: str, buckets: int) -> DataFrame:
    """Write each chunk's ids, lengths and ids of documents as flat files; return its
    words' hashes, training counts and classes by bucket, and a row with bucket -1 itself."""
    def run(batches):
        import xxhash

        pid, made = TaskContext.get().partitionId(), 0
        keys, held, texts, size = [], [], [], 0

        def flush():
            nonlocal made
            vocab: defaultdict = defaultdict()
            vocab.default_factory = vocab.__len__
            vocab[b""]  # the end of a text
            parts, lens = [], []
            for t in texts:
                w = t.lower().split()
                w.append(b"")
                parts.append(np.fromiter(map(vocab.__getitem__, w), np.uint32, len(w)))
                lens.append(len(w))
            ids, n = np.concatenate(parts), len(vocab)
            lengths, out = np.array(lens, np.int64), np.array(held, bool)
            counts = np.bincount(ids[np.repeat(~out, lengths)], minlength=n)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, vocab), np.uint64, n)
            classes = np.fromiter(map(_class, vocab), np.uint8, n)
            order = np.argsort(hashes)
            chunk = (pid << 32) + made
            made += 1
            for ext, a in (("tok", ids), ("len", lengths), ("key", np.array([k or 0 for k in keys], np.int64)), ("nul", np.array([k is None for k in keys], np.uint8)), ("out", out.view(np.uint8)), ("ord", order.astype(np.uint32)), ("hsh", hashes[order]), ("cls", classes)):
                common.put_file(f"{uri}/{chunk}.{ext}", [a.tobytes()])
            hashes, counts, classes = hashes[order], counts[order], classes[order]
            bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            rows = [{"chunk": chunk, "bucket": -1, "n": len(ids), "hashes": b"", "counts": b"", "classes": b""}]
            for b in range(buckets):
                s = slice(cut[b], cut[b + 1])
                if cut[b] < cut[b + 1]:
                    rows.append({"chunk": chunk, "bucket": b, "n": int(cut[b + 1] - cut[b]), "hashes": hashes[s].tobytes(), "counts": counts[s].astype("<u8" if counts[s].max() >= 1 << 32 else "<u4").tobytes(), "classes": classes[s].tobytes()})
            return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary()), ("classes", pa.binary())]))

        for b in batches:
            for k, t, h in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("held_out").to_pylist()):
                raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
                keys.append(k)
                held.append(h)
                texts.append(raw)
                size += len(raw)
                if size >= CHUNK_BYTES:
                    yield flush()
                    keys, held, texts, size = [], [], [], 0
        if keys:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    return rows.mapInArrow(run, "chunk long, bucket long, n long, hashes binary, counts binary, classes binary")


def _wide(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, "<u4" if len(blob) == 4 * n else "<u8").astype(np.int64)


def _end_hash() -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(b"")


def add_up(parts: DataFrame) -> DataFrame:
    """Corpus counts of each bucket's words, back to every chunk that has them in the order
    it sent; and per bucket a row with chunk -1: sums by class, the most frequent words and
    those that may be members, and the ends."""
    end = np.uint64(_end_hash())

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        n = t["n"].to_pylist()
        h = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in t["hashes"]])
        c = np.concatenate([_wide(x.as_py(), k) for x, k in zip(t["counts"], n)])
        k = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in t["classes"]])
        words, first, at = np.unique(h, return_index=True, return_inverse=True)
        total = np.bincount(at, c, len(words)).astype(np.int64)
        cls, is_end = k[first], words == end
        ends = int(total[is_end].sum())
        distinct, total_words = int((total > 0).sum()), np.where(is_end, 0, total)
        top = np.lexsort((words, -total_words))
        least = _least(int(total.sum()))  # not above that of the corpus
        top = top[: max(HEAD, int((total_words >= least).sum()))]
        back = np.split(total[at].astype("<u8"), np.cumsum(n)[:-1])
        b = t["bucket"][0].as_py()
        rows = [{"chunk": x, "bucket": b, "n": len(y), "counts": (y.astype("<u4") if y.max() < 1 << 32 else y).tobytes()} for x, y in zip(t["chunk"].to_pylist(), back)]
        rows.append({"chunk": -1, "bucket": b, "distinct": distinct, "ends": ends, "by_class": np.bincount(cls, total_words, CLASSES).astype(np.int64).tolist(), "once": np.bincount(cls[total_words == 1], minlength=CLASSES).tolist(), "top_word": words[top].view(np.int64).tolist(), "top_count": total_words[top].tolist(), "top_class": cls[top].astype(np.int64).tolist()})
        return pa.Table.from_pylist(rows, schema=pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("counts", pa.binary()), ("distinct", pa.int64()), ("ends", pa.int64()), *((x, pa.list_(pa.int64())) for x in ("by_class", "once", "top_word", "top_count", "top_class"))]))

    return parts.groupBy("bucket").applyInArrow(run, "chunk long, bucket long, n long, counts binary, distinct long, ends long, by_class array<long>, once array<long>, top_word array<long>, top_count array<long>, top_class array<long>")


def _least(tokens: int) -> int:
    """The count from which words are members."""
    return max(2, -(-math.isqrt(tokens) // MEMBERS))


def _by_row(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and the sums of their values."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first].astype(np.int64), np.add.reduceat(values.take(order, 0), first)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows."""
    return np.einsum("ij,ij->i", a, b)


def _log_shares(r: np.ndarray, q: np.ndarray, own: np.ndarray, room: np.ndarray) -> np.ndarray:
    """For each row of ``r`` the log of the share that ``own``, a row of ``q``, has in the exponentials of r . q, made in ``room``."""
    x = np.matmul(r, q.T, out=room[: len(r) * len(q)].reshape(len(r), len(q)))
    if x.max() > SAFE or x.min() < -SAFE:
        x -= x.max(1, keepdims=True)
    got = x[np.arange(len(x)), own]
    np.exp(x, out=x)
    return got - np.log((x @ np.ones(len(q), np.float32)).astype(np.float64))


class Network:
    """r = sum_i c_i * e[context_i]; the score of a symbol is r . q + b, that of an outcome
    within its class r . q2 + b2.

    Words have codes: those under SYMBOLS are symbols (of a class: its words that are not
    members), the others members, whose classes are ``member`` in ascending order.
    ``counts`` are those of the outcomes within classes: for each class the rest, then members.
    """

    def __init__(self, noise: np.ndarray, member: np.ndarray | None = None, counts: np.ndarray | None = None, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.noise = noise
        self.members = 0 if member is None else len(member)
        cls = np.arange(CLASSES) if member is None else np.concatenate([np.arange(CLASSES), member])
        counts = np.ones(len(cls)) if counts is None else counts
        self.symbol = np.concatenate([np.arange(SYMBOLS), 1 + HEAD + cls[CLASSES:]]).astype(np.uint8)
        self.share = counts / np.bincount(cls, counts)[cls]
        self.order = np.argsort(cls, kind="stable")
        self.cut = np.searchsorted(cls[self.order], np.arange(CLASSES + 1))
        self.cum = np.cumsum(self.share[self.order])
        self.q2 = np.zeros((len(cls), WIDTH), np.float32)
        self.b2 = np.log(self.share).astype(np.float32)
        self.e = rng.normal(0, 0.1, (SYMBOLS + self.members, WIDTH)).astype(np.float32)
        self.q = rng.normal(0, 0.1, (SYMBOLS, WIDTH)).astype(np.float32)
        self.c = np.ones((CONTEXT, WIDTH), np.float32)
        self.b = np.log(noise).astype(np.float32)
        self.sums = [np.full(p.shape, 1e-2, np.float32) for p in self.parameters()]
        self.room = np.empty((BATCH, NOISE), np.float32)

    def parameters(self):
        return [self.e, self.q, self.c, self.b, self.q2, self.b2]

    def pack(self) -> bytes:
        return b"".join(p.astype("<f4").tobytes() for p in [*self.parameters(), *self.sums])

    def unpack(self, blob: bytes) -> Network:
        flat, at = np.frombuffer(blob, "<f4"), 0
        out = []
        for p in [*self.parameters(), *self.sums]:
            out.append(flat[at : at + p.size].reshape(p.shape).copy())
            at += p.size
        (self.e, self.q, self.c, self.b, self.q2, self.b2), self.sums = out[:6], out[6:]
        return self

    def step(self, ctx: np.ndarray, word: np.ndarray, rng) -> None:
        """One batch of noise-contrastive estimation; the noise words are shared by the batch."""
        n, symbol = len(word), self.symbol[word]
        noise = rng.choice(SYMBOLS, NOISE, p=self.noise)
        e = [self.e.take(ctx[:, i], 0) for i in range(CONTEXT)]
        r = sum(x * self.c[i] for i, x in enumerate(e))
        prior = np.log(NOISE * self.noise).astype(np.float32)
        own = self.q.take(symbol, 0)
        true = 1 / (1 + np.exp(-(_dot(r, own) + (self.b - prior)[symbol])))
        down = np.matmul(r, -self.q[noise].T, out=self.room[:n])  # up to BATCH positions
        down -= (self.b - prior)[noise]
        np.exp(down, out=down)
        down += 1
        np.divide(-1, down, out=down)
        up = (1 - true)[:, None]
        dr = up * own + down @ self.q[noise]
        dq, db = np.zeros_like(self.q), np.bincount(symbol, up[:, 0], SYMBOLS).astype(np.float32)
        at, d = _by_row(symbol, up * r)
        dq[at] = d
        np.add.at(dq, noise, down.T @ r)
        np.add.at(db, noise, down.sum(0))
        inner = self._inner(word, symbol, r, dr, rng) if self.members else []
        dc = np.stack([np.einsum("ij,ij->j", dr, x) for x in e])
        at, de = _by_row(ctx.T.ravel(), (dr * self.c[:, None]).reshape(-1, WIDTH))
        full = slice(None)
        p, s = self.parameters(), self.sums
        # rare words take sums: means over the batch would vanish beside the start of their sums of squares
        for k, at, d in ((0, at, de), (1, full, dq / n), (2, full, dc / n), (3, full, db / n), *inner):
            s[k][at] += d * d
            p[k][at] += RATE * d / np.sqrt(s[k][at])

    def _inner(self, word: np.ndarray, symbol: np.ndarray, r: np.ndarray, dr: np.ndarray, rng) -> list:
        """The same within classes, with INNER_NOISE noise words for each class; adds to ``dr``."""
        low = np.flatnonzero(symbol > HEAD)
        if not len(low):
            return []
        low = low[np.argsort(symbol[low], kind="stable")]
        cls, out, r = symbol[low].astype(np.int64) - 1 - HEAD, word[low].astype(np.int64) - 1 - HEAD, r.take(low, 0)
        draw = np.searchsorted(self.cum, np.arange(CLASSES)[:, None] + rng.random((CLASSES, INNER_NOISE)), "right")
        noise = self.order[np.clip(draw, self.cut[:-1, None], self.cut[1:, None] - 1)]
        bias = self.b2 - np.log(INNER_NOISE * self.share).astype(np.float32)
        own = self.q2.take(out, 0)
        up = 1 - 1 / (1 + np.exp(-(_dot(r, own) + bias[out])))
        back = up[:, None] * own
        first = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
        rows, grads, steps = [out], [up[:, None] * r], [up]
        for m in range(INNER_NOISE):
            at = noise[cls, m]
            q = self.q2.take(at, 0)
            down = -1 / (1 + np.exp(-(_dot(r, q) + bias[at])))
            back += down[:, None] * q
            rows.append(at[first])
            grads.append(np.add.reduceat(down[:, None] * r, first))
            steps.append(np.add.reduceat(down, first))
        dr[low] += back
        at, d = _by_row(np.concatenate(rows), np.column_stack([np.concatenate(grads), np.concatenate(steps)]))
        return [(4, at, d[:, :WIDTH]), (5, at, d[:, WIDTH])]

    def log10(self, ctx: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of codes, by products of whole batches."""
        beside = lambda x, y: np.column_stack([x, y]).astype(np.float32)
        tables = [beside(self.e * self.c[i], np.full(len(self.e), i == 0)) for i in range(CONTEXT)]  # r ends in 1, which meets the biases
        q, q2 = beside(self.q, self.b), beside(self.q2, self.b2)[self.order]
        out, symbols = np.empty(len(word)), self.symbol[word]
        room = np.empty(SCORE_BATCH * max(SYMBOLS, np.diff(self.cut).max()), np.float32)
        for a in range(0, len(word), INNER_BATCH):
            symbol, ours = symbols[a : a + INNER_BATCH], out[a : a + INNER_BATCH]
            r = tables[0].take(ctx[a : a + INNER_BATCH, 0], 0)
            for i in range(1, CONTEXT):
                r += tables[i].take(ctx[a : a + INNER_BATCH, i], 0)
            for z in range(0, len(r), SCORE_BATCH):
                s = slice(z, z + SCORE_BATCH)
                ours[s] = _log_shares(r[s], q, symbol[s], room)
            if not self.members:
                continue
            low = np.flatnonzero(symbol > HEAD)
            low = low[np.argsort(symbol[low], kind="stable")]
            r, own = r.take(low, 0), word[a : a + INNER_BATCH][low].astype(np.int64)
            place = np.searchsorted(symbol[low], 1 + HEAD + np.arange(CLASSES + 1))
            for k in range(CLASSES):
                for z in range(place[k], place[k + 1] if self.cut[k + 1] - self.cut[k] > 1 else 0, SCORE_BATCH):
                    s = slice(z, min(z + SCORE_BATCH, place[k + 1]))
                    # the rest is first, members of a class follow each other
                    at = np.where(own[s] < SYMBOLS, 0, own[s] - HEAD - self.order[self.cut[k] + 1])
                    ours[low[s]] += _log_shares(r[s], q2[self.cut[k] : self.cut[k + 1]], at, room)
        return out / np.log(10)


def contexts(symbols: np.ndarray, lengths: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """The CONTEXT symbols before each position of its text, nearest first; 0 before a text."""
    place = np.full(len(symbols), CONTEXT, np.uint8)
    starts = np.cumsum(lengths) - lengths
    for i in range(CONTEXT):
        place[starts[lengths > i] + i] = i
    if at is not None:
        place = place[at]
    out = np.zeros((len(place), CONTEXT), symbols.dtype)
    for i in range(CONTEXT):
        ok = np.flatnonzero(place > i)
        out[ok, i] = symbols[(ok if at is None else at[ok]) - (i + 1)]
    return out


class Chunk:
    """A chunk's files, with the corpus counts and codes of its words."""

    def __init__(self, uri: str, chunk: int, head: np.ndarray, codes: np.ndarray):
        read = lambda ext, kind: common.read_array(f"{uri}/{chunk}.{ext}", kind)
        self.tokens, self.lengths, self.keys = read("tok", "<u4"), np.array(read("len", "<i8")), read("key", "<i8")
        self.null, self.out = np.array(read("nul", "u1"), bool), np.array(read("out", "u1"), bool)
        order, self.classes = read("ord", "<u4"), np.array(read("cls", "u1"))
        hashes, counts = read("hsh", "<u8"), read("cnt", "u1")
        self.counts = np.empty(len(order), np.int64)
        self.counts[order] = _wide(counts.tobytes(), len(order))
        self.codes = (1 + HEAD + self.classes.astype(np.int64)).astype(np.uint16 if codes.max(initial=0) < 1 << 16 else np.uint32)
        self.codes[0] = 0
        i = np.minimum(np.searchsorted(hashes, head), len(hashes) - 1)
        ok = np.asarray(hashes)[i] == head
        self.codes[np.asarray(order)[i[ok]]] = codes[ok]


def score(docs: DataFrame, stride: int = STRIDE) -> DataFrame:
    """Scores of all whole texts of ``docs`` (doc_id, text), learned from those not held out.

    Tokens are the words of the text with A-Z in lower case, and one end. Per row: doc_id,
    held_out, n_tokens, n_known (tokens seen in training), train_tokens, base_score (add-one
    unigram log10 probability) and score (the model's). Null text is empty: only the end.
    A null doc_id counts as the empty string for the split. Repeated rows are scored
    alike, and counted each. Without training rows nothing is known, and the network stays
    as it was initialised. Texts of any length are read whole, each in one chunk; words of
    equal counts are ordered by their hashes. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    uri = common.work_dir(spark, "lm")
    buckets = 2 * common.shuffle_partitions(spark)
    parts = common.stage(encode(docs, f"{uri}/chunks", buckets), f"{uri}/parts")
    totals = common.stage(add_up(parts.where("bucket >= 0")), f"{uri}/totals")
    sums = totals.where("chunk = -1")
    got = sums.agg(F.sum("distinct").alias("v"), F.sum("ends").alias("ends"), *(F.sum(F.col(k)[i]).alias(f"{k}{i}") for k in ("by_class", "once") for i in range(CLASSES))).collect()[0]
    distinct, ends = got["v"] or 0, got["ends"] or 0
    by_class, once = (np.array([got[f"{k}{i}"] or 0 for i in range(CLASSES)], np.int64) for k in ("by_class", "once"))
    n_train = int(by_class.sum()) + ends
    top = sums.select(F.explode(F.arrays_zip("top_word", "top_count", "top_class")).alias("t")).select("t.*").where("top_count > 0")
    first = top.orderBy(F.desc("top_count"), "top_word").limit(HEAD).collect()
    least = _least(n_train)
    found = {r["top_word"]: r for r in top.where(F.col("top_count") >= least).collect()}  # at most MEMBERS * sqrt(n_train)
    for r in first:
        found.pop(r["top_word"], None)
    rest = sorted(found.values(), key=lambda r: (r["top_class"], -r["top_count"], r["top_word"]))
    head = np.array([r["top_word"] for r in first + rest], np.int64).view(np.uint64)
    codes = np.concatenate([1 + np.arange(len(first)), SYMBOLS + np.arange(len(rest))])
    for r in first:
        by_class[r["top_class"]] -= r["top_count"]
        once[r["top_class"]] -= r["top_count"] == 1
    noise = np.concatenate([[ends], [r["top_count"] for r in first], np.zeros(HEAD - len(first)), by_class]) + 1.0
    noise /= noise.sum()
    member = np.array([r["top_class"] for r in rest], np.int64)
    for r in rest:
        by_class[r["top_class"]] -= r["top_count"]
    unknown = (once + 1) / (by_class + 2)
    shape = (noise, member, np.concatenate([by_class, [r["top_count"] for r in rest]]) + 1.0)

    _give_back(totals.where("chunk >= 0"), f"{uri}/chunks")
    chunks = parts.where("bucket = -1").select("chunk", "n")
    trained = train(chunks, f"{uri}/chunks", head, codes, shape, stride)
    floor = np.log10(n_train + distinct + 1)

    def run(batches):
        network = Network(*shape).unpack(trained)
        for b in batches:
            for chunk in b.column("chunk").to_pylist():
                c = Chunk(f"{uri}/chunks", chunk, head, codes)
                ids = np.asarray(c.tokens)
                within = np.zeros(len(c.counts))
                rest = (c.codes > HEAD) & (c.codes < SYMBOLS)
                k = c.classes[rest]
                seen = c.counts[rest]
                within[rest] = np.log10(np.where(seen > 0, (1 - unknown[k]) * seen / np.maximum(by_class[k], 1), unknown[k]))
                words = c.codes[ids]
                starts = np.cumsum(c.lengths) - c.lengths
                ends_ = starts + c.lengths
                model = np.empty(len(c.lengths))
                i = 0
                while i < len(c.lengths):  # whole texts of about a million tokens, or one longer text
                    j = max(i + 1, int(np.searchsorted(ends_, starts[i] + 1_000_000)))
                    s = slice(int(starts[i]), int(ends_[j - 1]))
                    got = network.log10(contexts(words[s], c.lengths[i:j]), words[s]) + within[ids[s]]
                    model[i:j] = np.add.reduceat(got, starts[i:j] - starts[i])
                    i = j
                base = np.add.reduceat(np.log10(c.counts + 1.0)[ids], starts) - c.lengths * floor
                known = np.add.reduceat((c.counts > 0)[ids].astype(np.int64), starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(c.keys), mask=c.null), pa.array(c.out), pa.array(c.lengths), pa.array(known), pa.array(np.full(len(known), n_train)), pa.array(base), pa.array(model)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return chunks.repartition(common.shuffle_partitions(spark)).mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _give_back(counts: DataFrame, uri: str) -> None:
    """Write each chunk's corpus counts beside its other files, in the order of its hashes."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("bucket")
        chunk = t["chunk"][0].as_py()
        total = np.concatenate([_wide(x.as_py(), n) for x, n in zip(t["counts"], t["n"].to_pylist())])
        common.put_file(f"{uri}/{chunk}.cnt", [total.astype("<u4" if total.max() < 1 << 32 else "<u8").tobytes()])
        return pa.table({"chunk": pa.array([chunk], pa.int64()), "words": pa.array([len(total)], pa.int64())})

    counts.groupBy("chunk").applyInArrow(run, "chunk long, words long").agg(F.sum("words")).collect()


def train(chunks: DataFrame, uri: str, head: np.ndarray, codes: np.ndarray, shape: tuple, stride: int) -> bytes:
    """The network after one pass over every ``stride``-th position of all training texts.

    One chunk gives a common start; from there each task goes through its chunks, and the
    tasks' parameters are averaged by the number of positions they saw.
    """
    spark = chunks.sparkSession

    def learn(network: Network, chunk: int) -> int:
        c = Chunk(uri, chunk, head, codes)
        words = c.codes[np.asarray(c.tokens)]
        free = np.flatnonzero(np.repeat(~c.out, c.lengths))[chunk % stride :: stride]
        rng = np.random.default_rng(chunk)
        rng.shuffle(free)
        ctx = contexts(words, c.lengths)
        for a in range(0, len(free), BATCH):
            at = free[a : a + BATCH]
            network.step(ctx[at], words[at], rng)
        return len(free)

    def task(start: bytes | None):
        def run(batches):
            network, seen = Network(*shape), 0
            network = network.unpack(start) if start else network
            for b in batches:
                for chunk in b.column("chunk").to_pylist():
                    seen += learn(network, chunk)
            yield pa.RecordBatch.from_pydict({"seen": pa.array([seen], pa.int64()), "net": pa.array([network.pack()], pa.binary())})

        return run

    def average(batches):
        seen, total = 0, None
        for b in batches:
            for n, blob in zip(b.column("seen").to_pylist(), b.column("net").to_pylist()):
                x = np.frombuffer(blob, "<f4").astype(np.float64) * n
                seen, total = seen + n, x if total is None else total + x
        if seen:
            yield pa.RecordBatch.from_pydict({"seen": pa.array([seen], pa.int64()), "net": pa.array([(total / seen).astype("<f4").tobytes()], pa.binary())})

    kind = "seen long, net binary"
    first = chunks.orderBy("chunk").limit(1).mapInArrow(task(None), kind).collect()
    start = first[0]["net"] if first else Network(*shape).pack()
    nets = chunks.repartition(common.shuffle_partitions(spark)).mapInArrow(task(start), kind).where("seen > 0")
    nets = nets.repartition(16).mapInArrow(average, kind).collect()  # at most 16 rows
    if not nets:
        return start
    merged = average([pa.RecordBatch.from_pydict({"seen": [r["seen"] for r in nets], "net": pa.array([bytes(r["net"]) for r in nets], pa.binary())})])
    return next(merged).column("net")[0].as_py()
