"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown on the driver from a bounded sample of labelled rows, flattened into
arrays (feature, threshold, child) and applied by vectorised traversal on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BATCH_BYTES = 4_000_000
#: Labelled rows the trees are grown from: those first by a hash of the id.
TRAIN_ROWS = 20_000

FEATURES = (
    "log_bytes", "log_words", "bytes_per_word", "word_length_sd", "long_words", "upper", "lower", "digit", "space", "newline", "non_ascii",
    "stop_marks", "exclamation", "question", "pipe", "star_hash", "money_percent", "brackets", "slash_at", "other_marks", "distinct_words",
    "top_word", "caps_words", "title_words", "marked_words", "log_lines", "words_per_line", "distinct_lines", "ended_lines", "short_lines", "byte_entropy",
)


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars.encode())] = 1
    return out


_CLASSES = np.stack([
    _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("abcdefghijklmnopqrstuvwxyz"), _class("0123456789"), _class(" \t"), _class("\n"),
    np.r_[np.zeros(128), np.ones(128)], _class(".,;:"), _class("!"), _class("?"), _class("|"), _class("*#"), _class("$%&"), _class("()[]{}<>"), _class("/@\\_="), _class("\"'`-+~^"),
], axis=1)
_MARKED = bytes(1 if chr(b) in "!*#$%&|<>{}[]=~^\\" else 0 for b in range(256))


def statistics(text: str | None) -> list[float]:
    """FEATURES of a whole text; all 0 for null and empty texts."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(FEATURES)
    n = len(raw)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = hist @ _CLASSES / n
    p = hist[hist > 0] / n
    words = raw.split()
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    caps = title = marked = 0
    for w, c in counts.items():
        first = w[0]
        if 0x41 <= first <= 0x5A:
            if len(w) > 1 and w.isupper():
                caps += c
            else:
                title += c
        if any(w.translate(_MARKED)):
            marked += c
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k = max(1, len(lines))
    per_line = [x.count(b" ") + 1 for x in lines]
    return [
        np.log1p(n), np.log1p(len(words)), n / m, float(lengths.std()) if len(words) else 0.0, float((lengths > 12).mean()) if len(words) else 0.0, *share.tolist(),
        len(counts) / m, max(counts.values(), default=0) / m, caps / m, title / m, marked / m,
        np.log1p(len(lines)), m / k, len(set(lines)) / k, sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / k, sum(x < 6 for x in per_line) / k, float(-(p * np.log2(p)).sum()),
    ]


@dataclass
class Trees:
    """Boosted trees as arrays: node i of tree t splits on ``feature[t, i]`` at
    ``threshold[t, i]`` (to the left if <=) into ``left`` and ``right``; leaves point to themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int32)
            for _ in range(self.depth):
                go = x[rows, self.feature[t, node]] <= self.threshold[t, node]
                node = np.where(go, self.left[t, node], self.right[t, node])
            out += self.value[t, node]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 20, ridge: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss; splits are sought in histograms of quantile bins.

    Without rows, the score is 1/2; with one label only, near that label. Ties between
    splits go to the first feature and bin.
    """
    nodes = 2 ** (depth + 1) - 1
    n, f = len(x), len(FEATURES)
    feature, left, right = np.zeros((trees, nodes), np.int32), *(np.tile(np.arange(nodes, dtype=np.int32), (trees, 1)) for _ in range(2))
    threshold, value = np.full((trees, nodes), np.inf), np.zeros((trees, nodes))
    mean = (y.sum() + 0.5) / (n + 1.0)
    model = Trees(feature, threshold, left, right, value, float(np.log(mean / (1 - mean))), depth)
    if n < 2 * least or not 0 < y.sum() < n:
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(f)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(f)], axis=1).astype(np.int64)
    at = binned + np.arange(f) * bins
    raw = np.full(n, model.base)
    for t in range(trees):
        prob = 1 / (1 + np.exp(-raw))
        g, h = y - prob, np.maximum(prob * (1 - prob), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            key = ((node - first)[:, None] * (f * bins) + at).ravel()
            live = np.repeat(node >= first, f)
            key = key[live]
            sums = [np.bincount(key, np.repeat(v, f)[live], width * f * bins).reshape(width, f, bins) for v in (g, h, np.ones(n))]
            gl, hl, nl = (np.cumsum(s, axis=2) for s in sums)
            gt, ht, nt = (s[:, :, -1:] for s in (gl, hl, nl))
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(nl < least) | (nt - nl < least)] = -1
            for j, e in enumerate(edges):
                gain[:, j, len(e) :] = -1
            best = gain.reshape(width, -1).argmax(1)
            for w in range(width):
                if gain[w].flat[best[w]] <= 1e-6:
                    continue
                i, (j, b) = first + w, divmod(int(best[w]), bins)
                feature[t, i], threshold[t, i] = j, edges[j][b]
                left[t, i], right[t, i] = 2 * i + 1, 2 * i + 2
                mine = node == i
                node[mine] = np.where(binned[mine, j] <= b, 2 * i + 1, 2 * i + 2)
        top = np.bincount(node, g, nodes), np.bincount(node, h, nodes)
        value[t] = rate * top[0] / (top[1] + ridge)
        raw += value[t, node]
    return model


def held_out(col: str = "doc_id"):
    """True for rows no label may be learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """Trees from at most ``rows`` labelled documents that are not held out.

    Labels with a null id or quality are left out; of several labels of an id the
    greatest holds, of several texts the one of the smallest hash. Features come from the
    text alone.
    """
    good = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    good = good.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th")).join(F.broadcast(good), "doc_id")  # at most ``rows`` ids

    def run(batches):
        for b in common.batched(batches, "text", BATCH_BYTES):
            x = np.array([statistics(t.as_py()) for t in b.column("text")]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_pydict({"key": b.column("doc_id"), "th": b.column("th"), "y": b.column("quality").cast(pa.int64()), "x": pa.array(list(x), pa.list_(pa.float64()))})

    one = sample.mapInArrow(run, "key long, th long, y long, x array<double>").groupBy("key").agg(F.min(F.struct("th", "y", "x")).alias("r"))
    got = one.select("key", "r.y", "r.x").toArrow().sort_by("key")
    x = np.array(got["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    return grow(x, (got["y"].to_numpy() > 0).astype(float))


def _scores(b: pa.RecordBatch, model: Trees) -> np.ndarray:
    x = np.array([statistics(t.as_py()) for t in b.column("text")]).reshape(-1, len(FEATURES))
    return model.score(x)


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: quality 1 likelier) and predicted of each row.

    Null and empty texts have all statistics 0 and get the score of such texts. A null
    doc_id is never in the labels and is not held out. Repeated rows are scored alike.
    Without labels every score is 1/2 and predicted 1. Texts of any length are read whole. An
    empty table gives an empty result. Other columns are ignored.
    """
    model = fit(docs, labels, rows)

    def run(batches):
        for b in common.batched(batches, "text", BATCH_BYTES):
            s = _scores(b, model)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "score": s, "predicted": pa.array((s >= 0.5).astype(np.int32))})

    rows_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out().alias("held_out"))
    return rows_.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` without the rows whose score is below 1/2; all columns are kept, whatever
    their names.

    Null, empty and very long texts, repeated rows and null ids are scored as by ``classify``,
    so rows of one text stay or go together. A score of 1/2 stays: so does every row where
    there are no labels to learn from. An empty table stays empty.
    """
    model = fit(docs, labels, rows)

    def run(batches):
        for b in common.batched(batches, "text", BATCH_BYTES):
            yield b.filter(pa.array(_scores(b, model) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
