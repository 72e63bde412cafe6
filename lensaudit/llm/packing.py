"""Best-fit packing into bins of several permitted lengths.

Pieces of one length are interchangeable, so best-fit-decreasing runs on the driver over
a histogram of at most ``max(capacities)`` lengths, with bins of equal contents kept as
one group. It yields placements for ranges of ranks; executors rank the pieces of each
length and look up bin and offset.

Lengths are token counts of a tokenizer, whose ids are kept with the pieces, so that
``sequences`` can put each bin's ids together; or words, or a column.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, token_files
from .fit import CapacityTree

CAPACITIES = (1024, 2048, 4096)
#: Text encoded at a time.
TOKEN_BYTES = 4_000_000
#: Words are runs of characters other than space and U+0009 to U+000D; a text ends with one token.
WORDS = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Run:
    """Ranks ``lo`` to ``hi`` of the pieces of ``size``: ``each`` to a bin, from ``bin`` on, at ``offset``."""

    size: int
    lo: int
    hi: int
    bin: int
    each: int
    offset: int


def downsize(used: int, capacities: tuple[int, ...]) -> int:
    return min(c for c in capacities if c >= used)


def best_fit(hist: list[tuple[int, int]], opening: tuple[int, ...], capacities: tuple[int, ...], cost) -> tuple[float, list[Run]]:
    """Best-fit-decreasing of (size, count) pairs; new bins are of one of ``opening``.

    A new bin has the size whose cost for each token of it that equal pieces would fill is
    least, the smaller on ties. At the end each bin counts as the smallest of
    ``capacities`` that holds its contents. Returns the total cost and the placements.
    """
    tree, groups, runs, bins = CapacityTree(), {}, [], 0
    # groups: (remaining, first bin) -> (bins, used)
    for size, count in sorted(hist, reverse=True):
        done = 0
        while done < count:
            key = tree.ceiling((size, -1))
            if key is None:
                cap = min((c for c in opening if c >= size), key=lambda c: (cost(c) / (c // size * size), c))
                key, n, used = (cap, bins), -(-(count - done) // (cap // size)), 0
                bins += n
            else:
                tree.remove(key)
                n, used = groups.pop(key)
            rem, first = key
            each = rem // size
            k = min(count - done, n * each)
            full, extra = divmod(k, each)
            runs.append(Run(size, done, done + k, first, each, used))
            for at, m, put in ((first, full, each), (first + full, int(extra > 0), extra), (first + full + (extra > 0), n - full - (extra > 0), 0)):
                if m:
                    tree.insert((rem - put * size, at))
                    groups[rem - put * size, at] = (m, used + put * size)
            done += k
    total = sum(m * cost(downsize(used, capacities)) for m, used in groups.values())
    return total, runs


def plan(hist: list[tuple[int, int]], capacities: tuple[int, ...], cost=float) -> list[Run]:
    """The cheapest of the packings that open bins of each set of permitted sizes with the largest."""
    top = max(capacities)
    rest = [c for c in capacities if c != top]
    sets = [tuple(sorted((*some, top))) for k in range(len(rest) + 1) for some in combinations(rest, k)]
    return min((best_fit(hist, s, capacities, cost) for s in sets), key=lambda got: got[0])[1]


def _tokenized(docs: DataFrame, tokenizer: str, end_id: int, top: int, cache_units: int) -> DataFrame:
    """Pieces of at most ``top`` token ids of each text, which ``end_id`` closes; ids are bytes, as
    in token files."""

    def run(batches):
        encoder = token_files.kept_encoder(tokenizer, cache_units)
        for b in common.batched(batches, "text", TOKEN_BYTES):
            flat, n = encoder.batch(b.column("text"), end_id)
            k = -(-n // top)
            row = np.repeat(np.arange(len(n)), k)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
            size = np.minimum(top, n[row] - piece * top)
            ends = np.concatenate([[0], np.cumsum(size)]) * flat.itemsize
            ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), pa.array(piece), pa.array(piece * top), pa.array(size), ids], ["doc_id", "piece", "start", "length", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece long, start long, length long, ids binary")


def _place(pieces: DataFrame, capacities: tuple[int, ...], cost) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ...), without ids, with bin and offset."""
    spark = pieces.sparkSession
    hist = [(r["length"], r["count"]) for r in pieces.groupBy("length").count().collect()]  # at most max(capacities) rows
    runs = plan(hist, tuple(capacities), cost)
    names = ("size", "lo", "hi", "bin", "each", "offset")
    table = spark.createDataFrame(pa.table({f"_{x}": pa.array([getattr(r, x) for r in runs], pa.int64()) for x in names}))
    ranked = common.spread_rank(pieces.drop("ids"), ["length"], ["doc_id", "piece"], "_rank")
    inside = (F.col("length") == F.col("_size")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    at = F.col("_rank") - F.col("_lo")
    placed = ranked.join(F.broadcast(table) if len(runs) <= 200_000 else table, inside)
    return placed.select(*(c for c in pieces.columns if c != "ids"), (F.col("_bin") + F.expr("(_rank - _lo) div _each")).alias("bin"), (F.col("_offset") + at % F.col("_each") * F.col("length")).alias("offset"))


def _fits(capacities: tuple[int, ...]):
    return F.coalesce(*(F.when(F.col("used") <= c, F.lit(c)) for c in sorted(capacities))).cast("int")


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, length: str | None = None, cost=float, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of the permitted ``capacities``.

    A document's length is its tokens by the library's ``tokenizer`` file, or its words, and
    one end token; or the column ``length``. Longer documents are cut into pieces of the
    largest capacity and a rest. Per piece: doc_id, piece, start (in the document), length,
    bin, offset (in the bin), used (of the bin) and capacity (the smallest permitted that
    holds the bin).

    Null and empty texts are pieces of length 1; null or non-positive lengths give no
    piece. Texts of any length are read whole. Repeated rows are packed each. Ties between
    equal pieces go by doc_id, then piece. An empty table gives an empty result. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    top = max(capacities)
    if tokenizer:
        pieces = _tokenized(docs, tokenizer, end_id, top, token_files.CACHE_UNITS).drop("ids")
    else:
        n = F.col(length).cast("long") if length else F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORDS)).cast("long") + 1
        rows = docs.select("doc_id", n.alias("n")).where("n > 0")
        pieces = rows.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {top}"))).alias("piece"))
        pieces = pieces.select("doc_id", "piece", (F.col("piece") * top).alias("start"), F.least(F.lit(top).cast("long"), F.col("n") - F.col("piece") * top).alias("length"))
    pieces = common.stage(pieces, f"{common.work_dir(spark, 'pack')}/pieces")
    placed = _place(pieces, capacities, cost)
    return placed.withColumn("used", F.sum("length").over(Window.partitionBy("bin"))).withColumn("capacity", _fits(capacities))


def sequences(docs: DataFrame, tokenizer: str, capacities: tuple[int, ...] = CAPACITIES, end_id: int = 0, cost=float, cache_units: int = token_files.CACHE_UNITS) -> DataFrame:
    """The packed sequences: a row for each bin of ``pack`` with the tokenizer's lengths.

    Columns: bin, capacity, used, ids (of all pieces, end to end: little-endian unsigned
    integers as in token files, of 2 bytes, or 4 for over 65,536 ids), and by piece, in the
    order of their offsets, doc_ids, starts (in the document), lengths and offsets (in the
    sequence). At most ``max(capacities)`` ids meet in a row. Null and empty texts are one end
    token; repeated rows are packed each; texts over the largest capacity are cut into pieces;
    pieces of equal length fill their bins in the order of their rows. An empty table gives an
    empty result. Other columns are ignored.
    """
    work = common.work_dir(docs.sparkSession, "sequences")
    pieces = _tokenized(docs, tokenizer, end_id, max(capacities), cache_units).withColumn("row", F.monotonically_increasing_id())
    pieces = common.stage(pieces, f"{work}/pieces")  # written, so that rows keep their numbers
    placed = _place(pieces, capacities, cost).select("row", "bin", "offset")
    part = F.struct("offset", "doc_id", "start", "length", "ids")
    bins = pieces.join(placed, "row").groupBy("bin").agg(F.array_sort(F.collect_list(part)).alias("p"), F.sum("length").alias("used"))
    each = {"doc_ids": "doc_id", "starts": "start", "lengths": "length", "offsets": "offset"}
    return bins.select("bin", _fits(capacities).alias("capacity"), "used", F.aggregate("p", F.lit(b""), lambda all_, x: F.concat(all_, x["ids"])).alias("ids"), *(F.col(f"p.{c}").alias(name) for name, c in each.items()))
