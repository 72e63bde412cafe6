"""Benchmark decontamination with a generalised suffix automaton over item words.

Items are cut into blocks of bounded size; one automaton stands for all substrings of a
block's items. Each is built once, by a task of its own, and written as flat arrays, which
the tasks that scan documents read. A document's words are streamed through it, keeping the length of the
longest match that ends at each word. Runs of words whose pairs occur in no item cannot
hold a match and are skipped by array operations first.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 13
#: Words of items in one automaton: about 10 MB as flat arrays. More items are several
#: automata, of which a worker keeps the first KEPT and reads the others for each batch.
BLOCK_WORDS, KEPT = 100_000, 12
BATCH_BYTES = 4_000_000
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    """Lower-case A-Z; words are runs of digits, letters and non-ASCII characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Automaton:
    """All windows of some items: ``window`` consecutive words, or a whole shorter item."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window, self.vocab = window, {}
        self.nxt, self.link, self.len = [{}], [-1], [0]
        items = [(k, [self.vocab.setdefault(w, len(self.vocab)) for w in ws]) for k, ws in items if ws]
        for _, ids in items:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.shortest = min((min(window, len(ids)) for _, ids in items), default=window)
        self._items, self._short = {}, {}
        for k, ids in items:
            s = 0
            if len(ids) < window:
                for c in ids:
                    s = self.nxt[s][c]
                self._short.setdefault(s, []).append((len(ids), k))
                continue
            for i, c in enumerate(ids):
                s = self.nxt[s][c]
                if i + 1 >= window:
                    self._items.setdefault(self._up(s), set()).add(k)
        pairs = {a * len(self.vocab) + b for _, ids in items for a, b in zip(ids, ids[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)

    def _extend(self, last: int, c: int) -> int:
        """Add a word after state ``last`` (0 starts a new item); returns the new last state."""
        nxt, link, length = self.nxt, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.nxt, self.link, self.len
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def _up(self, s: int) -> int:
        """The state of the last ``window`` words of a state's strings."""
        while self.len[self.link[s]] >= self.window:
            s = self.link[s]
        return s

    def frozen(self) -> bytes:
        """The automaton as flat arrays, to be read by ``Frozen``."""
        n = len(self.vocab)
        edges = sorted((s * n + c, t) for s, to in enumerate(self.nxt) for c, t in to.items())
        found = {k for items in self._items.values() for k in items} | {k for short in self._short.values() for _, k in short}
        names = sorted(found, key=lambda k: (k is None, k))
        at = {k: i for i, k in enumerate(names)}
        windows = sorted((s, at[k]) for s, items in self._items.items() for k in items)
        short = sorted((s, m, at[k]) for s, some in self._short.items() for m, k in some)
        out = io.BytesIO()
        np.savez(
            out, words=np.frombuffer(b" ".join(self.vocab), np.uint8), names=np.frombuffer(json.dumps(names).encode(), np.uint8), limits=np.array([self.window, self.shortest]), pairs=self.pairs,
            edges=np.array([e for e, _ in edges], np.int64), to=np.array([t for _, t in edges], np.int32), link=np.array(self.link, np.int32), len=np.array(self.len, np.int32),
            windows=np.array(windows, np.int32).reshape(-1, 2), short=np.array(short, np.int32).reshape(-1, 3),
        )
        return out.getvalue()

    def stream(self, ids: list[int]) -> Iterator[tuple[int, int, object]]:
        """As ``Frozen.stream``."""
        return Frozen(self.frozen()).stream(ids)


class Frozen:
    """A finished automaton over flat arrays: edges are found by binary search."""

    def __init__(self, data: bytes):
        got = np.load(io.BytesIO(data))
        self.vocab = {w: i for i, w in enumerate(got["words"].tobytes().split())}
        self.window, self.shortest = map(int, got["limits"])
        self.pairs = got["pairs"]
        self._names = json.loads(got["names"].tobytes())
        self._edges, self._to, self._link, self._len = (array(t, got[k].tobytes()) for k, t in (("edges", "q"), ("to", "i"), ("link", "i"), ("len", "i")))
        self._windows, self._window_items = array("i", got["windows"][:, 0].tobytes()), got["windows"][:, 1]
        self._short: dict[int, list] = {}
        for s, m, k in got["short"].tolist():
            self._short.setdefault(s, []).append((m, self._names[k]))
        self._chains: dict[int, list] = {}

    def _step(self, s: int, c: int) -> int:
        """The state after word ``c`` in state ``s``; -1 without such an edge."""
        key = s * len(self.vocab) + c
        i = bisect_left(self._edges, key)
        return self._to[i] if i < len(self._edges) and self._edges[i] == key else -1

    def _found(self, s: int) -> set:
        """The items that hold the last ``window`` words of a state's strings."""
        while self._len[self._link[s]] >= self.window:
            s = self._link[s]
        a = bisect_left(self._windows, s)
        return {self._names[k] for k in self._window_items[a : bisect_left(self._windows, s + 1, a)]}

    def _chain(self, s: int) -> list:
        """(state, length, item) of the whole short items that end strings of ``s``."""
        if not self._short:
            return []
        got = self._chains.get(s)
        if got is None:
            got, t = [], s
            while t > 0:
                got += [(t, n, k) for n, k in self._short.get(t, ())]
                t = self._link[t]
            self._chains[s] = got
        return got

    def runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of ``ids`` (-1: no item's word) that may hold a window."""
        known = ids >= 0
        if self.shortest < 2:
            ok = known
        else:
            both = np.flatnonzero(known[:-1] & known[1:])
            code = ids[both].astype(np.int64) * len(self.vocab) + ids[both + 1]
            at = np.searchsorted(self.pairs, code)
            both = both[self.pairs[np.minimum(at, len(self.pairs) - 1)] == code] if len(self.pairs) else both[:0]
            ok = np.zeros(len(ids), bool)
            ok[both] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], ok.view(np.int8), [0]])))
        more = 0 if self.shortest < 2 else 1
        return [(int(a), int(z) + more) for a, z in edge.reshape(-1, 2) if z - a + more >= self.shortest]

    def stream(self, ids: list[int]) -> Iterator[tuple[int, int, object]]:
        """(first, last word, items) of the last window or short item of matches, over one stretch."""
        s = n = 0
        for i, c in enumerate(ids):
            t = self._step(s, c) if c >= 0 else 0
            while t < 0 and s:
                s = self._link[s]
                n = self._len[s]
                t = self._step(s, c)
            s = max(t, 0)
            n = n + 1 if s else 0
            if n >= self.window:
                yield i - self.window + 1, i, self._found(s)
            for t, m, k in self._chain(s):
                if t != s or m <= n:
                    yield i - m + 1, i, {k}


def scan(texts: list[str | None], automata: Iterator[Frozen]) -> list[tuple[np.ndarray, set]]:
    """For each text, which of its words are hit, and the items whose windows occur."""
    split = [words(t) for t in texts]
    size = np.array([len(w) for w in split], np.int64)
    start = np.cumsum(size + 1) - size - 1
    hit = np.zeros(int((size + 1).sum()), bool)
    items: dict[int, set] = {}
    for auto in automata:
        ids = np.full(len(hit), -1, np.int32)
        for w, a in zip(split, start):
            ids[a : a + len(w)] = np.fromiter(map(auto.vocab.get, w, repeat(-1)), np.int32, len(w))
        for a, z in auto.runs(ids):
            for i, j, found in auto.stream(ids[a:z].tolist()):
                hit[a + i : a + j + 1] = True
                items.setdefault(int(np.searchsorted(start, a, "right")) - 1, set()).update(found)
    return [(hit[a : a + n], items.get(i, set())) for i, (a, n) in enumerate(zip(start, size))]


def _write_items(benchmark: DataFrame, uri: str) -> list[list[str]]:
    """Items as JSON in the shared folder, in files of at most BLOCK_WORDS words or one item;
    the URIs by block: small files, as of many partitions, make one block together."""

    def write(batches):
        pid, block, size, made, sizes = TaskContext.get().partitionId(), [], 0, [], []

        def flush():
            made.append(f"{uri}/items-{pid:06d}-{len(made):06d}.json")
            sizes.append(size)
            common.put_file(made[-1], [json.dumps(block).encode()])

        for b in batches:
            for k, t in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist()):
                n = len(words(t))
                if block and size + n > BLOCK_WORDS:
                    flush()
                    block, size = [], 0
                if n:
                    block.append([k, t])
                    size += n
        if block:
            flush()
        yield pa.RecordBatch.from_pydict({"uri": pa.array(made, pa.string()), "words": pa.array(sizes, pa.int64())})

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    files = sorted(map(tuple, items.mapInArrow(write, "uri string, words long").collect()))  # a row for each file
    blocks: list[list[str]] = []
    size = 0
    for name, n in files:
        if not blocks or size + n > BLOCK_WORDS:
            blocks.append([])
            size = 0
        blocks[-1].append(name)
        size += n
    return blocks


def _write_automata(benchmark: DataFrame, window: int) -> list[str]:
    """URIs of the frozen automata of all blocks, each built by one task."""
    spark, uri = benchmark.sparkSession, common.work_dir(benchmark.sparkSession, "items")
    blocks = _write_items(benchmark, uri)
    if not blocks:
        return []

    def build(batches):
        for b in batches:
            made = []
            for i, uris in zip(b.column("block").to_pylist(), b.column("uris").to_pylist()):
                items = [item for u in uris for item in json.loads(_read(u))]
                made.append(f"{uri}/automaton-{i:06d}.npz")
                common.put_file(made[-1], [Automaton([(k, words(t)) for k, t in items], window).frozen()])
            yield pa.RecordBatch.from_pydict({"uri": pa.array(made, pa.string())})

    rows = spark.createDataFrame(list(enumerate(blocks)), "block int, uris array<string>").repartition(len(blocks))
    return sorted(r.uri for r in rows.mapInArrow(build, "uri string").collect())  # a row for each block


def _read(uri: str) -> bytes:
    fs, path = common.open_uri(uri)
    with fs.open_input_file(path) as f:
        return f.read()


class _Items:
    """The automata of all blocks: the first KEPT are read once, of the others one at a time is held."""

    def __init__(self, uris: list[str]):
        self._uris = uris
        self._kept: list[Frozen] = []

    def __iter__(self):
        for i, uri in enumerate(self._uris):
            if i < len(self._kept):
                yield self._kept[i]
                continue
            auto = Frozen(_read(uri))
            if i < KEPT:
                self._kept.append(auto)
            yield auto


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = 20) -> DataFrame:
    """How much of each of ``docs`` (doc_id, text) lies in windows of ``benchmark`` (item_id, text).

    Per row: doc_id, n_words, n_hit (words inside an occurrence of a window), n_items,
    items_sha256 (of the item_ids, sorted as strings and joined by commas), contaminated
    (n_hit > 0 and coverage * n_hit >= n_words). Null and empty texts have no words and
    no hits; items without words have no window; an item_id that comes more than once
    counts once; items with a null id hit words but are not listed. Repeated documents
    are rows of their own; texts of any length are read whole. An empty table gives an
    empty result, an empty benchmark no hits. Other columns are ignored.
    """
    uris = _write_automata(benchmark, window)

    def run(batches):
        automata = _Items(uris)
        for b in common.batched(batches, "text", BATCH_BYTES):
            found = scan(b.column("text").to_pylist(), automata)
            n, hit = [len(h) for h, _ in found], [int(h.sum()) for h, _ in found]
            names = [sorted(x for x in k if x is not None) for _, k in found]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_hit": pa.array(hit, pa.int64()), "n_items": pa.array([len(k) for k in names], pa.int64()), "items_sha256": [hashlib.sha256(",".join(k).encode()).hexdigest() for k in names], "contaminated": [h > 0 and coverage * h >= w for w, h in zip(n, hit)]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def cut_spans(text: str, hit: np.ndarray, least: int) -> str:
    """``text`` without the runs of at least ``least`` hit words, from first to last byte."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw.translate(_TABLE))]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).reshape(-1, 2)
    out, last = [], 0
    for a, z in edge:
        if z - a >= least:
            out.append(raw[last : at[a][0]])
            last = at[z - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = 20, span: int | None = None) -> DataFrame:
    """``docs`` without contaminated rows (see ``contamination``); all columns are kept.

    With ``span``, runs of at least so many hit words are also cut out of the texts that
    stay. Without it these are unchanged. Null and empty texts stay; an empty table stays
    empty. Needs no shuffle.
    """
    uris = _write_automata(benchmark, window)

    def run(batches):
        automata = _Items(uris)
        for b in common.batched(batches, "text", BATCH_BYTES):
            texts = b.column("text").to_pylist()
            found = scan(texts, automata)
            keep = [not (h.sum() > 0 and coverage * int(h.sum()) >= len(h)) for h, _ in found]
            if span is not None:
                texts = [cut_spans(t, h, span) if t and h.any() else t for t, (h, _) in zip(texts, found)]
                b = b.set_column(b.schema.get_field_index("text"), "text", pa.array(texts, b.schema.field("text").type))
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
