"""Exact top-k by inner product over vector-approximation files.

Executors write blocks to the shared folder: a file of quantised cells (one byte for
each component) beside the file of exact integer vectors. A search scans the cells of a
block for bounds of all scores by one matrix product, then reads exact vectors in the
order of their best possible score until nothing unread can enter the first k.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

BLOCK, QUERY_BLOCK, SCAN_ROWS, CELLS = 16_384, 2_048, 256, 256
#: Candidate blocks are dealt to at most so many groups; a group keeps k rows for a query.
GROUPS = 32
#: Vectors with a component of this size or more are kept as doubles (whole numbers), in blocks of their own.
WIDE = 1 << 61
_LONG = 1 << 63


def _vectors(batch: pa.RecordBatch, key: str, col: str, scale: float):
    """(ids, whole numbers as doubles) by dimension. Null ids and vectors, empty vectors, and
    vectors with a component that is null, or not finite, or not finite once scaled, take no part."""
    ids, rows = batch.column(key), batch.column(col)
    rows = rows.cast(pa.list_(pa.float64()))
    by: dict[int, tuple[list, list]] = {}
    offsets, flat = rows.offsets.to_numpy(), rows.values
    values = flat.to_numpy(zero_copy_only=False)  # nulls become NaN
    for i, (k, there) in enumerate(zip(ids.to_pylist(), rows.is_valid().to_pylist())):
        v = values[offsets[i] : offsets[i + 1]]
        if there and k is not None and len(v) and np.isfinite(v).all():
            got = by.setdefault(len(v), ([], []))
            got[0].append(k)
            got[1].append(v)
    out = {}
    for d, (k, v) in by.items():
        with np.errstate(over="ignore"):
            x = np.floor(scale * np.stack(v))
        fine = np.isfinite(x).all(axis=1)
        if fine.any():
            out[d] = np.array(k, np.int64)[fine], x[fine]
    return out


def _put(uri: str, name: str, **arrays: np.ndarray) -> None:
    for ext, a in arrays.items():
        common.put_file(f"{uri}/{name}.{ext}", [np.ascontiguousarray(a).tobytes()])


def write_files(vectors: DataFrame, uri: str, key: str, col: str, scale: float, every: int) -> list:
    """Blocks of cells and vectors, and blocks of the queries; a manifest row for each."""

    def write(batches):
        pid, row = TaskContext.get().partitionId(), 0
        held: dict[tuple[str, int, bool], list] = {}

        def flush(kind, dim, wide, n):
            parts = held.pop((kind, dim, wide))
            ids, x, uid = (np.concatenate(c) for c in zip(*parts))
            if len(ids) > n:
                held[kind, dim, wide] = [(ids[n:], x[n:], uid[n:])]
                ids, x, uid = ids[:n], x[:n], uid[:n]
            name = f"{kind}-{pid:06d}-{int(uid[0])}-{dim}"
            dtype = "<f8" if wide else "<i2" if np.abs(x).max() < 1 << 15 else "<i8"
            files = {"vec": x.astype(dtype), "ids": np.stack([ids, uid]).astype("<i8")}
            if kind == "c" and not wide:
                x = x.astype(np.int64)
                lo = x.min(0)
                width = -(-(x.max(0) - lo + 1) // CELLS)
                files |= {"cell": ((x - lo) // width).astype("u1"), "grid": np.stack([lo, width]).astype("<i8")}
            _put(uri, name, **files)
            return {"name": name, "kind": kind, "dim": dim, "n": len(ids), "dtype": dtype}

        for b in batches:
            for dim, (ids, x) in _vectors(b, "key", "vec", scale).items():
                uid = (pid << 32) + row + np.arange(len(ids), dtype=np.int64)
                row += len(ids)
                ask, far = ids % every == 0, np.abs(x).max(axis=1) >= WIDE
                for kind, n, mine in (("c", BLOCK, np.ones(len(ids), bool)), ("q", QUERY_BLOCK, ask)):
                    for wide in (False, True):
                        if (of := mine & (far == wide)).any():
                            held.setdefault((kind, dim, wide), []).append((ids[of], x[of], uid[of]))
                            while (kind, dim, wide) in held and sum(len(p[0]) for p in held[kind, dim, wide]) >= n:
                                yield pa.RecordBatch.from_pylist([flush(kind, dim, wide, n)])
        for part in list(held):
            yield pa.RecordBatch.from_pylist([flush(*part, BLOCK)])

    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(col).alias("vec"))
    return rows.mapInArrow(write, "name string, kind string, dim long, n long, dtype string").collect()  # a row for each block


def _products(x: np.ndarray, q: np.ndarray, most: int) -> np.ndarray:
    """Inner products of rows of ``x`` (of components up to ``most``) with ``q``: 64-bit where none can
    leave them, else Python's integers."""
    if x.dtype.kind == "i" and q.dtype.kind == "i" and most * int(np.abs(q).max()) * len(q) < _LONG:
        return x.astype(np.int64) @ q
    whole = [int(v) for v in q.tolist()]
    return np.array([sum(int(a) * b for a, b in zip(row, whole)) for row in x.tolist()], object)


def scan(cells: np.ndarray | None, grid: np.ndarray | None, exact: np.ndarray, ids: np.ndarray, uid: np.ndarray, q: np.ndarray, q_uid: np.ndarray, best: list, k: int) -> None:
    """Bring ``best``, a (scores, ids) pair of at most k for each query, up to date with one block.

    A component in cell j of a dimension lies in lo + width * [j, j + 1), so with the
    cell's centre c the score is within r = sum |q| (width - 1) / 2 of q . c. Blocks of wide
    vectors have no cells: there c is the vector, and r what rounding may add.
    """
    if cells is None:
        centre, spread, most = np.asarray(exact, np.float64), np.zeros(exact.shape[1]), int(np.abs(exact).max(initial=0))
    else:
        lo, width = grid
        centre, spread = lo + width * cells.astype(np.float64) + (width - 1) / 2, (width - 1) / 2
        most = max(int(np.abs(lo).max()), int(np.abs(lo + width * CELLS).max()))
    size = np.abs(q.astype(np.float64))
    with np.errstate(over="ignore", invalid="ignore"):
        slack = size @ spread
        exact_in_float = float(size.max(initial=0)) * float(most) * len(spread) < 1 << 52
        slack = slack + (0 if exact_in_float else 1 + size.sum(1) * float(np.abs(centre).max(initial=0)) * len(spread) * 2.0**-50)
    slack = np.where(np.isnan(slack), np.inf, slack)
    where = {int(u): i for i, u in enumerate(uid)} if np.isin(q_uid, uid).any() else {}
    for a in range(0, len(q), SCAN_ROWS):
        with np.errstate(over="ignore", invalid="ignore"):
            about = q[a : a + SCAN_ROWS].astype(np.float64) @ centre.T
        for i in range(about.shape[0]):
            row, r = about[i], slack[a + i]
            if not np.isfinite(r) or not np.isfinite(row).all():
                row, r = np.zeros(len(row)), np.inf  # too large for doubles: no bound, all are read
            if (own := where.get(int(q_uid[a + i]))) is not None:
                row[own] = -np.inf
            scores, got = best[a + i]
            need = float(scores[-1]) if len(scores) == k else -np.inf
            if len(row) > k and np.isfinite(r):
                need = max(need, np.partition(row, len(row) - k)[len(row) - k] - r)  # k rows have at least this
            near = np.flatnonzero((row + r >= need) & (row > -np.inf))
            near = near[np.argsort(-row[near], kind="stable")]
            step = max(k, 32)
            for z in range(0, len(near), step):
                if len(scores) == k and row[near[z]] + r < float(scores[-1]):
                    break  # the best that is left cannot enter
                pick = near[z : z + step]
                s = np.concatenate([scores, _products(exact[pick], q[a + i], most)])
                v = np.concatenate([got, ids[pick]])
                order = np.lexsort((v, -s))[:k] if s.dtype.kind == "i" else sorted(range(len(s)), key=lambda j: (-s[j], v[j]))[:k]  # noqa: B023
                scores, got = s[order], v[order]
            best[a + i] = (scores, got)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, key: str = "vec_id", col: str = "embedding") -> DataFrame:
    """For each row whose ``key`` is divisible by ``every``, the k other rows of the highest
    integer inner product of floor(scale * component): query_id, rank, vec_id, score.

    Ties go to the smaller id. A query's own row is left out, other rows with its id are
    not; repeated query rows are separate queries. Rows with null ids or vectors, empty
    vectors, or null or non-finite components take no part; vectors are compared only
    within their dimension. Fewer than k rows give fewer results, none give none.
    Scores are exact whatever the size of components; only where one of the first k itself leaves
    64 bits, which its column cannot hold, the query fails. Other columns are ignored.
    """
    spark = vectors.sparkSession
    uri = common.work_dir(spark, "va")
    blocks = write_files(vectors, uri, key, col, scale, every)
    tasks = []
    for dim in sorted({b["dim"] for b in blocks}):
        cand = sorted((b["name"], b["n"], b["dtype"]) for b in blocks if b["dim"] == dim and b["kind"] == "c")
        groups = [cand[i::GROUPS] for i in range(min(GROUPS, len(cand)))]
        tasks += [(dim, q, g) for q in sorted((b["name"], b["n"], b["dtype"]) for b in blocks if b["dim"] == dim and b["kind"] == "q") for g in groups]

    def search(batches):
        def load(name, n, dtype, dim):
            ids = common.read_array(f"{uri}/{name}.ids", "<i8").reshape(2, n)
            return ids[0], ids[1], common.read_array(f"{uri}/{name}.vec", dtype).reshape(n, dim)

        for b in batches:
            for t in b.column("id").to_pylist():
                if t >= len(tasks):
                    continue
                dim, ask, group = tasks[t]
                q_ids, q_uid, q = load(*ask, dim)
                q = np.array(q, np.float64 if ask[2] == "<f8" else np.int64)
                best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(q)
                for name, n, dtype in group:
                    ids, uid, x = load(name, n, dtype, dim)
                    cells, grid = (None, None) if dtype == "<f8" else (common.read_array(f"{uri}/{name}.cell", "u1").reshape(n, dim), common.read_array(f"{uri}/{name}.grid", "<i8").reshape(2, dim))
                    scan(cells, grid, x, np.asarray(ids), np.asarray(uid), q, np.asarray(q_uid), best, k)
                n = [len(s) for s, _ in best]
                scores = [int(x) for s, _ in best for x in s]
                over = [(x >= _LONG) - (x < -_LONG) for x in scores]
                yield pa.RecordBatch.from_pydict({"query_id": np.repeat(q_ids, n), "uid": np.repeat(q_uid, n), "vec_id": np.concatenate([v for _, v in best]), "score": pa.array([0 if o else x for o, x in zip(over, scores)], pa.int64()), "over": pa.array(over, pa.int32())})

    n = max(1, len(tasks))
    found = spark.range(0, n, 1, n).mapInArrow(search, "query_id long, uid long, vec_id long, score long, over int")
    rank = F.row_number().over(Window.partitionBy("query_id", "uid").orderBy(F.desc("over"), F.desc("score"), "vec_id"))
    score = F.when(F.col("over") == 0, F.col("score")).otherwise(F.raise_error(F.lit("a score among the first does not fit 64 bits")).cast("long"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))
