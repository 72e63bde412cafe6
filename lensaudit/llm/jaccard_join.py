"""N-gram Jaccard join: a grouped prefix join over sets of word shingles.

Sets are arrays of 64-bit shingle hashes. Under one order of all shingles, two sets of
Jaccard similarity 4/5 or more share one of their first ``n - ceil(4 n / 5) + 1`` shingles
(the prefix). Equal sets form a class; classes with the same prefix and size form a
group, which is indexed once. Groups that share a prefix shingle are candidates; they are
expanded to classes, filtered by size and by sketches that give upper bounds of the
intersection, and verified on whole texts.

The order is by hash, with the most frequent shingles last, so that passages which many
documents share do not fill the index. Frequencies change the cost only: the join is
exact under any order.

Links are sought until components are known. First the members of each candidate list
are compared with the one that has the fewest rare shingles, which is what copies have in
common. Then all pairs that are still in different components are settled: in short lists
pair by pair, in long ones in blocks of sets against blocks of sets, which return links
only. So a group of copies costs about its size, and no task holds more than two blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
BATCH_BYTES = 2_000_000
#: Bytes of input to a bucket of the index, which one task lists.
BUCKET_BYTES = 32_000_000
#: A block of documents reports shingles that at least so many of its sets have; those
#: reported LEAST times or more in all are put last in the order, at most MOST_FREQUENT of
#: them (8 bytes each).
BLOCK_SHINGLES, OFTEN, LEAST, MOST_FREQUENT = 2_000_000, 2, 4, 1_000_000
#: Sets that one cell of a comparison holds, and sets streamed past it; past a single one, fewer.
BLOCK_SETS, STREAM_SETS, STREAM_ONE = 256, 256, 32
#: Lists up to this size are settled pair by pair.
SHORT_LIST = 64
#: Up to so many documents to fetch (about 60 bytes each) are broadcast to the scan of texts.
BROADCAST_ROWS = 500_000
#: Up to so many links (16 bytes each) are contracted by one task, more by many.
TASK_LINKS = 1_000_000
#: Shingles below this hash make a set's sketch, 16 bits of each.
SKETCH_BELOW = np.uint64((1 << 64) // 5)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_NODE = "did long, th long, n long, rare long, cid long, gid long, kind int, bucket int, tokens binary, gids binary, sizes binary, places binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[0x41:0x5B] += np.uint64(32)
_BASE = 0x9E3779B97F4A7C15


_kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64; the usual size is kept."""
    if n not in _kept:
        with np.errstate(over="ignore"):
            got = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, x, np.uint64)])) for x in (np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))))
        if n > 1 << 21:
            return got
        _kept[n] = got
    return _kept[n]


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a byte array, and where they start: a polynomial of the
    bytes, with A-Z in lower case, by one running sum over the array, then mixed."""
    inside = ~_SPACE[raw]
    edge = np.diff(np.concatenate([[False], inside, [False]]).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(max(1 << 21, 1 << len(raw).bit_length()))
    with np.errstate(over="ignore"):
        total = np.cumsum(np.concatenate([[np.uint64(0)], _LOWER[raw] * up[: len(raw)]]))
        return _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: every SHINGLE consecutive words, or the
    whole sequence of fewer; A-Z in lower case. Empty for texts without words."""
    if not texts:
        return []
    size = np.array([len(t) + 1 for t in texts], np.int64)
    h, starts = word_hashes(np.frombuffer(b" ".join(texts) + b" ", np.uint8))
    cut = np.searchsorted(starts, np.concatenate([[0], np.cumsum(size)]))
    out = []
    with np.errstate(over="ignore"):
        k = max(0, len(h) - SHINGLE + 1)
        runs = np.full(k, SHINGLE, np.uint64)
        for i in range(SHINGLE):
            runs = (runs * _M1) ^ _mix(h[i : i + k] + np.uint64(i + 1))
        runs = _mix(runs)
        for a, z in zip(cut[:-1].tolist(), cut[1:].tolist()):
            n = z - a
            if n >= SHINGLE:
                s = np.sort(runs[a : z - SHINGLE + 1])
                new = np.ones(len(s), bool)
                np.not_equal(s[1:], s[:-1], out=new[1:])
                out.append(s[new])
            elif n:
                s = np.full(1, n, np.uint64)
                for i in range(n):
                    s = (s * _M1) ^ _mix(h[a + i : a + i + 1] + np.uint64(i + 1))
                out.append(_mix(s))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def late(sets: list[np.ndarray], frequent: np.ndarray) -> list[np.ndarray]:
    """For each set, which of its shingles are frequent."""
    if not len(frequent) or not sets:
        return [np.zeros(len(s), bool) for s in sets]
    flat = np.concatenate(sets)
    at = np.searchsorted(frequent, flat)
    hit = frequent[np.minimum(at, len(frequent) - 1)] == flat
    return np.split(hit, np.cumsum([len(s) for s in sets])[:-1])


def sketch(s: np.ndarray) -> bytes:
    """16 bits of each shingle in the lowest fifth of the hashes, sorted."""
    return np.sort((s[: np.searchsorted(s, SKETCH_BELOW)] >> np.uint64(16)).astype("<u2")).tobytes()


def may_be_similar(a: bytes, n: int, b: bytes, m: int) -> bool:
    """False only for sets that are not similar: no more is common than what their sketches
    have in common and the smaller rest."""
    x, y = np.frombuffer(a, "<u2"), np.frombuffer(b, "<u2")
    both = 0
    if len(x) and len(y):
        (u, i), (v, j) = (np.unique(z, return_counts=True) for z in (x, y))
        at = np.minimum(np.searchsorted(v, u), len(v) - 1)
        both = int(np.minimum(i, j[at])[v[at] == u].sum())
    both += min(n - len(x), m - len(y))
    return 100 * both >= 80 * (n + m - both)


def prefix_size(n: int) -> int:
    return n - -(-4 * n // 5) + 1


def _hash(a: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(a.tobytes()) - (1 << 63)


def _texts(b: pa.RecordBatch) -> list[bytes]:
    return [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in b.column("text")]


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """The shingles most often reported by blocks of documents, at most MOST_FREQUENT."""

    def run(batches):
        seen, held, size = set(), [], 0

        def report():
            s, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= OFTEN
            return pa.RecordBatch.from_pydict({"s": s[often].view(np.int64), "n": n[often]})

        for b in common.batched(batches, "text", BATCH_BYTES):
            for s in shingle_sets(_texts(b)):
                key = _hash(s)
                if len(s) and key not in seen:
                    seen.add(key)
                    held.append(s)
                    size += len(s)
                if size >= BLOCK_SHINGLES:
                    yield report()
                    held, size = [], 0
        if held:
            yield report()

    got = docs.select("text").mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    got = got.where(F.col("n") >= LEAST).orderBy(F.desc("n"), "s").limit(MOST_FREQUENT).select("s").toArrow()
    return np.sort(got["s"].to_numpy().view(np.uint64)) if len(got) else np.empty(0, np.uint64)


def signatures(docs: DataFrame, frequent: np.ndarray, buckets: int) -> DataFrame:
    """Rows of three kinds: 0 a document with its class and group; 1 index entries of rare
    prefix shingles, packed by bucket; 2 the frequent prefix shingles of a group."""
    order = docs.sparkSession.sparkContext.broadcast(frequent)  # at most MOST_FREQUENT

    def run(batches):
        last, seen = order.value, set()
        names = [x.split()[0] for x in _NODE.split(", ")]
        kinds = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in _NODE.split(", ")]
        for b in common.batched(batches, "text", BATCH_BYTES):
            out = {k: [] for k in names}

            def put(**row):
                for k, v in out.items():
                    v.append(row.get(k))

            entries = []
            sets = shingle_sets(_texts(b))
            for did, th, s, is_late in zip(b.column("did").to_pylist(), b.column("th").to_pylist(), sets, late(sets, last)):
                n = len(s)
                if not n:
                    put(did=did, th=th, n=0, kind=0)
                    continue
                p, rare = prefix_size(n), s[~is_late]
                first, rest = rare[:p], s[is_late][: max(0, p - len(rare))]
                cid, gid = _hash(s), _hash(np.concatenate([first, rest, [np.uint64(n)]]))
                put(did=did, th=th, n=n, rare=len(rare), cid=cid, gid=gid, kind=0, tokens=sketch(s))
                if gid in seen:
                    continue
                seen.add(gid)
                entries.append((first, gid, n))
                if len(rest):
                    put(gid=gid, n=n, kind=2, rare=len(first), tokens=rest.tobytes())
            if entries:
                t = np.concatenate([e[0] for e in entries])
                k = [len(e[0]) for e in entries]
                g, z = (np.repeat(np.array([e[i] for e in entries], np.int64), k) for i in (1, 2))
                place = np.concatenate([np.arange(x) for x in k])
                # prefixes hold the smallest hashes, so buckets are ranges of a mixed hash
                with np.errstate(over="ignore"):
                    by = (_mix(t) >> np.uint64(32)).astype(np.int64) * buckets >> 32
                o = np.argsort(by, kind="stable")
                t, g, z, place, by = t[o], g[o], z[o].astype("<i4"), place[o].astype("<i4"), by[o]
                cut = np.searchsorted(by, np.arange(buckets + 1))
                for i in range(buckets):
                    if cut[i] < cut[i + 1]:
                        s = slice(cut[i], cut[i + 1])
                        put(kind=1, bucket=i, tokens=t[s].tobytes(), gids=g[s].tobytes(), sizes=z[s].tobytes(), places=place[s].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[k], kind) for k, kind in zip(names, kinds)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("did"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _NODE)


def _reach(n, rest):
    """The greatest size of a set that can be similar to one of size ``n``, if their first common
    shingle is followed by so few (``rest``, itself included): 9 rest / 4 - n."""
    return (9 * rest) // 4 - n


def _lists(index: DataFrame) -> DataFrame:
    """(lh, gid) of the groups that share a rare prefix shingle; equal lists come once a bucket.

    Of neighbours by size, those too far apart for any pair are parted. A group whose place
    of the shingle leaves too few others for the smallest of its list is dropped from it."""

    def run(t: pa.Table) -> pa.Table:
        tok, gid, size, place = (np.concatenate([np.frombuffer(x.as_py(), kind) for x in t[c]]).astype(to) for c, kind, to in (("tokens", "<u8", np.uint64), ("gids", "<i8", np.int64), ("sizes", "<i4", np.int64), ("places", "<i4", np.int64)))
        o = np.lexsort((gid, size, tok))
        tok, gid, size, place = tok[o], gid[o], size[o], place[o]
        new = np.ones(len(tok), bool)
        new[1:] = (tok[1:] != tok[:-1]) | (gid[1:] != gid[:-1])

        def parts(keep):
            nonlocal tok, gid, size, place
            tok, gid, size, place = tok[keep], gid[keep], size[keep], place[keep]
            first = np.ones(len(tok), bool)
            first[1:] = (tok[1:] != tok[:-1]) | (5 * size[:-1] < 4 * size[1:])
            at = np.flatnonzero(first)
            return at, np.diff(np.append(at, len(tok)))

        at, n = parts(new)
        for _ in range(2):
            at, n = parts((_reach(size, size - place) >= np.repeat(size[at], n)) & np.repeat(n > 1, n))
        with np.errstate(over="ignore"):
            lh = np.add.reduceat(_mix(gid.view(np.uint64)), at) + n.astype(np.uint64) if len(at) else np.empty(0, np.uint64)
        some = np.flatnonzero(n > 1)
        _, pick = np.unique(lh[some], return_index=True)
        pick = some[pick]
        rows = np.repeat(at[pick] - np.cumsum(n[pick]) + n[pick], n[pick]) + np.arange(int(n[pick].sum()))
        return pa.table({"lh": pa.array(np.repeat(lh[pick], n[pick]).view(np.int64)), "gid": pa.array(gid[rows])})

    return index.groupBy("bucket").applyInArrow(run, "lh long, gid long")


def _frequent_lists(rows: DataFrame, work: str) -> DataFrame:
    """The same for frequent prefix shingles, whose lists may be long: joins, no task holds a list.
    What long lists are joined to is written first, so that the join is split by its skew."""
    rows = common.stage(rows.distinct(), f"{work}/hot")
    least = rows.groupBy("lh").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("k")).where("k > 1")
    least = common.stage(least, f"{work}/least")
    reach = F.floor(F.lit(9) * (F.col("n") - F.col("place")) / 4) - F.col("n")
    return rows.join(least, "lh").where(reach >= F.col("least")).select("lh", "gid")


def _contract(batches):
    """Node and root of the components of one task's edges, by union-find."""
    up: dict[int, int] = {}

    def root(x):
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, top)
        return top

    for b in batches:
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist()):
            x, y = root(u), root(v)
            up[max(x, y)] = up[min(x, y)] = min(x, y)
    nodes = sorted(up)
    for i in range(0, len(nodes), 10_000):
        part = nodes[i : i + 10_000]
        yield pa.RecordBatch.from_pydict({"node": pa.array(part, pa.int64()), "root": pa.array([root(x) for x in part], pa.int64())})


def components(edges: DataFrame, work: str) -> DataFrame:
    """(node, root): the smallest node of each connected component.

    Up to TASK_LINKS edges are contracted by one task. More are by large and small stars,
    each step written to the shared folder; the driver sees two sums for each."""
    edges = common.stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{work}/edges0")
    n = edges.count()
    if n <= TASK_LINKS:
        return edges.coalesce(1).mapInArrow(_contract, "node long, root long")
    files = 1 + n // 200_000
    step, before = 0, None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = common.stage(large, f"{work}/large{step}", files=files)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        step += 1
        edges = common.stage(small, f"{work}/edges{step}", files=files)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        if now == before:
            break
        before = now
    return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


class _Block:
    """Sets held by a cell: all shingles in order, with the set each belongs to."""

    def __init__(self, keys: list[int], comps: list[int], sets: list[np.ndarray]):
        self.keys, self.comps, self.n = keys, comps, np.array([len(s) for s in sets], np.int64)
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.n)
        o = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[o], owner[o]

    def links(self, s: np.ndarray) -> np.ndarray:
        """Which of the sets are similar to ``s``."""
        lo, hi = np.searchsorted(self.flat, s, "left"), np.searchsorted(self.flat, s, "right")
        k = hi - lo
        at = np.repeat(lo - np.cumsum(k) + k, k) + np.arange(int(k.sum()))
        both = np.bincount(self.owner[at], minlength=len(self.n))
        return 100 * both >= 80 * (self.n + len(s) - both)


def verify(units: DataFrame, members: DataFrame, docs: DataFrame, work: str) -> DataFrame:
    """(a, b, ok): comparisons of ``units`` (u, side, cid, comp) by whole texts.

    In each unit the classes of side 1 are compared with those of side 0 that are in other
    components. Side 0 is dealt into blocks and side 1 into salts; a cell holds one block
    and streams one salt past it. A link is returned for each component that a class is
    similar to; of units with one class on side 0 the failures are returned too.
    """
    sizes = units.groupBy("u").agg(F.ceil(F.count_if(F.col("side") == 0) / BLOCK_SETS).cast("int").alias("nb"), F.count_if(F.col("side") == 0).alias("k"), F.count_if(F.col("side") == 1).alias("m"))
    sizes = sizes.select("u", "nb", F.ceil(F.col("m") / F.when(F.col("k") == 1, STREAM_ONE).otherwise(STREAM_SETS)).cast("int").alias("ns"))
    dealt = units.join(common.stage(sizes.where("nb > 0 and ns > 0"), f"{work}/sizes"), "u")
    spread = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = lambda n: F.array(F.pmod(F.xxhash64("cid"), F.col(n)).cast("int"))
    held = F.col("side") == 0
    dealt = dealt.withColumn("block", F.explode(F.when(held, own("nb")).otherwise(spread("nb")))).withColumn("salt", F.explode(F.when(held, spread("ns")).otherwise(own("ns"))))
    asks = dealt.join(members.select("cid", F.col("doc.did").alias("_did"), F.col("doc.th").alias("_th")), "cid").select("u", "block", "salt", "side", "cid", "comp", "_did", "_th")
    asks = common.stage(asks, f"{work}/asks")
    asks = F.broadcast(asks) if asks.count() <= BROADCAST_ROWS else asks
    here = (F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))) == F.col("_did")) & (F.xxhash64("text") == F.col("_th"))
    rows = docs.join(asks, here).select("u", "block", "salt", "side", "cid", "comp", "text")
    rows = rows.repartition(common.shuffle_partitions(units.sparkSession), "u", "block", "salt").sortWithinPartitions("u", "block", "salt", "side", "cid")

    def run(batches):
        cell, held, block = None, [], None
        for batch in batches:
            for b in common.batched([batch], "text", BATCH_BYTES):
                out = {"a": [], "b": [], "ok": []}

                def put(a, to, ok):
                    for k, v in zip(out, (a, to, ok)):
                        out[k].append(v)

                keys = zip(*(b.column(c).to_pylist() for c in ("u", "block", "salt")))
                for key, side, cid, comp, s in zip(keys, b.column("side").to_pylist(), b.column("cid").to_pylist(), b.column("comp").to_pylist(), shingle_sets(_texts(b))):
                    if key != cell:
                        cell, held, block = key, [], None
                    if side == 0:
                        held.append((cid, comp, s))
                        continue
                    if block is None and held:
                        block = _Block(*map(list, zip(*held)))
                    if block is None:
                        continue
                    ok, done = block.links(s), {comp}
                    if len(ok) == 1 and not ok[0]:
                        put(cid, block.keys[0], False)
                    for i in np.flatnonzero(ok).tolist():
                        if block.comps[i] not in done and block.keys[i] != cid:
                            done.add(block.comps[i])
                            put(cid, block.keys[i], True)
                yield pa.RecordBatch.from_arrays([pa.array(out["a"], pa.int64()), pa.array(out["b"], pa.int64()), pa.array(out["ok"], pa.bool_())], ["a", "b", "ok"])

    return rows.mapInArrow(run, "a long, b long, ok boolean").distinct()


def prune(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) that sketches cannot rule out."""
    of = lambda c: members.select(F.col("cid").alias(c), F.col("n").alias(f"n_{c}"), F.col("doc.sketch").alias(f"s_{c}"))

    def run(batches):
        for b in batches:
            ok = [may_be_similar(*x) for x in zip(*(b.column(c).to_pylist() for c in ("s_a", "n_a", "s_b", "n_b")))]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "s_a", "n_b", "s_b").mapInArrow(run, "a long, b long")


def _one_each(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components as units: b against its a's."""
    held = pairs.select(F.col("b").alias("u"), F.lit(0).alias("side"), F.col("b").alias("cid"), F.lit(None).cast("long").alias("comp")).distinct()
    return held.unionByName(pairs.select(F.col("b").alias("u"), F.lit(1).alias("side"), F.col("a").alias("cid"), F.lit(-1).cast("long").alias("comp")))


def _open_units(open_: DataFrame, failed: DataFrame, members: DataFrame) -> DataFrame:
    """All comparisons left in ``open_`` lists (lh, cid, n, comp, k): pairs of short lists that
    did not fail before; of long lists the members of the greatest component against the
    rest, once for the component, and the rest against itself."""
    short, long_ = open_.where(F.col("k") <= SHORT_LIST), open_.where(F.col("k") > SHORT_LIST)
    x, y = short.alias("x"), short.alias("y")
    pairs = x.join(y, F.col("x.lh") == F.col("y.lh")).where("x.cid > y.cid and x.comp <> y.comp and 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)").select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")).distinct()
    pairs = prune(pairs.join(failed, (F.col("b") == F.col("lo")) & (F.col("a") == F.col("hi")), "left_anti"), members)
    count = long_.groupBy("lh", "comp").agg(F.count(F.lit(1)).alias("c"))
    most = count.groupBy("lh").agg(F.max(F.struct("c", "comp"))["comp"].alias("top"))
    rows = long_.join(most, "lh")
    inside = F.col("comp") == F.col("top")
    great = rows.select(F.xxhash64("top", F.lit("component")).alias("u"), F.when(inside, 0).otherwise(1).alias("side"), "cid", "comp").distinct()
    rest = rows.where(~inside).select(F.xxhash64("lh", F.lit("list")).alias("u"), F.explode(F.array(F.lit(0), F.lit(1))).alias("side"), "cid", "comp")
    return _one_each(pairs).unionByName(great).unionByName(rest)


@dataclass
class Joined:
    """``docs``: did, th, n, cid of every row; ``roots``: node, root of the classes that have links."""

    docs: DataFrame
    roots: DataFrame


def join(docs: DataFrame) -> Joined:
    """Classes of ``docs`` (doc_id, text) and the components of their links."""
    spark: SparkSession = docs.sparkSession
    work = common.work_dir(spark, "jaccard")
    rows = docs.select("doc_id", "text")
    frequent = frequent_shingles(rows)
    buckets = common.buckets(rows, BUCKET_BYTES)
    sig = common.stage(signatures(rows, frequent, buckets), f"{work}/sig", ["kind"])
    nodes = sig.where("kind = 0").select("did", "th", "n", "rare", "cid", "gid", F.col("tokens").alias("sketch"))

    hot = sig.where("kind = 2").select("gid", "n", "rare", "tokens").mapInArrow(_unpack, "lh long, gid long, n long, place long")
    lists = _lists(sig.where("kind = 1").select("bucket", "tokens", "gids", "sizes", "places")).unionByName(_frequent_lists(hot, work)).distinct()
    members = nodes.where("n > 0").groupBy("cid", "gid", "n", "rare").agg(F.min(F.struct(F.coalesce("did", F.lit(-(1 << 63))).alias("did"), "th", "sketch")).alias("doc"))
    members = common.stage(members, f"{work}/members")
    several = members.groupBy("gid").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("gid")
    own = members.join(several, "gid").select(F.col("gid").alias("lh"), "cid", "n", "rare")
    cand = lists.join(members, "gid").select("lh", "cid", "n", "rare").unionByName(own).distinct()
    cand = common.stage(cand, f"{work}/cand")
    common.release(spark, f"{work}/sig/kind=1", f"{work}/sig/kind=2")

    order = F.floor(100 * F.col("rare") / F.col("n"))
    pivot = cand.groupBy("lh").agg(F.min(F.struct(order.alias("o"), F.col("cid").alias("p"), F.col("n").alias("pn"))).alias("v"))
    pivot = common.stage(pivot, f"{work}/pivot")
    near = cand.join(pivot, "lh").where("cid <> v.p and 5 * least(n, v.pn) >= 4 * greatest(n, v.pn)")
    stars = common.stage(near.select(F.col("cid").alias("a"), F.col("v.p").alias("b")).distinct(), f"{work}/stars")
    likely = common.stage(prune(stars, members), f"{work}/likely")
    found = common.stage(verify(_one_each(likely), members, rows, f"{work}/first"), f"{work}/found")
    links = found.where("ok").select("a", "b")
    failed = stars.join(links, ["a", "b"], "left_anti").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    roots = common.stage(components(links, f"{work}/cc0"), f"{work}/roots0")
    common.release(spark)

    named = cand.join(roots, cand["cid"] == roots["node"], "left").select("lh", "cid", "n", F.coalesce("root", "cid").alias("comp"))
    lists = named.groupBy("lh").agg(F.count(F.lit(1)).alias("k"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("lh", "k")
    lists = common.stage(lists, f"{work}/unsettled")
    open_ = common.stage(named.join(lists, "lh"), f"{work}/open")
    units = common.stage(_open_units(open_, failed, members), f"{work}/units")
    more = common.stage(verify(units, members, rows, f"{work}/second"), f"{work}/more")
    links = links.unionByName(more.where("ok").select("a", "b"))
    roots = common.stage(components(links, f"{work}/cc1"), f"{work}/roots1")
    common.release(spark)
    return Joined(nodes.select("did", "th", "n", "cid"), roots)


def _unpack(batches):
    for b in batches:
        for gid, n, rare, t in zip(b.column("gid").to_pylist(), b.column("n").to_pylist(), b.column("rare").to_pylist(), b.column("tokens")):
            tok = np.frombuffer(t.as_py(), "<i8")
            k = len(tok)
            yield pa.RecordBatch.from_pydict({"lh": tok, "gid": np.full(k, gid), "n": np.full(k, n), "place": rare + np.arange(k)})


def _with_components(joined: Joined) -> DataFrame:
    """did, th, n and comp (the component's key) and component_id (its smallest doc_id)."""
    docs = joined.docs.join(joined.roots, joined.docs["cid"] == joined.roots["node"], "left").select("did", "th", "n", F.coalesce("root", "cid").alias("comp"))
    least = docs.where("n > 0").groupBy("comp").agg(F.min("did").alias("component_id"))
    return docs.where("n > 0").join(least, "comp").select("did", "th", "n", "comp", "component_id").unionByName(docs.where("n = 0").select("did", "th", "n", F.lit(None).cast("long").alias("comp"), F.col("did").alias("component_id")))


def link_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable by links, of every row.

    A set is the distinct shingles of 5 words, or the whole sequence of fewer. Two rows
    link when 100 * intersection >= 80 * union. Rows without words (null or empty text)
    have no shingles and link with nothing. Repeated rows and equal texts are one class.
    A null doc_id takes part, but is never the smallest; components of null ids alone
    have a null component_id. Texts of any length are read whole. An empty table gives an
    empty result. Other columns are ignored. Equal sets are told by 64-bit hashes of them,
    shingles by 64-bit hashes of their words.
    """
    return _with_components(join(docs)).select(F.col("did").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (null last), then
    the smallest hash of the text; rows that agree in both are one. Rows without words stay.
    Texts of any length are read whole. An empty table stays empty. All columns are kept."""
    found = _with_components(join(docs)).where("n > 0")
    d, h, did, th = common.fresh(docs, "_d", "_h", "_did", "_th")
    first = found.groupBy("comp").agg(F.min(F.struct(F.col("did").isNull().alias("none"), "did", "th")).alias("f")).select(F.coalesce("f.did", F.lit(-(1 << 63))).alias(did), F.col("f.th").alias(th))
    rows = docs.withColumn(d, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn(h, F.xxhash64("text"))
    words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    with_words = rows.where(words).join(first, (F.col(d) == F.col(did)) & (F.col(h) == F.col(th))).dropDuplicates([d, h])
    return with_words.select(docs.columns).unionByName(rows.where(~words).select(docs.columns))
