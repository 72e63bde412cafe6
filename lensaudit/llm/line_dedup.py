"""Line dedup by winnowing over line hashes.

A window is a shortest run of whole lines, ending at some line, of at least ``least``
words. Each window selects the smallest of its line hashes; equal windows select equal
lines, so any repeated run of ``least`` words shares a fingerprint. Positions whose
fingerprint comes more than once are joined by the contents of the windows that selected
them, and by those of each window with the lines before it that can begin a repeated run
without a window of their own (its leads); each match with the first occurrence is
compared line by line, extended both ways, and the later run is deleted. So every run of ``least``
words that stands earlier goes, whichever occurrence it is that it repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common

LEAST_WORDS = 50
BATCH_BYTES = 4_000_000
#: Windows and leads of so much text are held as Python objects.
LINES_BYTES = 500_000
_KEY = ("did", "th")


def lines_of(text: str | None) -> list[tuple[int, bytes]]:
    """(line number, stripped UTF-8 line) of the lines that are not blank."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return [(i, s) for i, x in enumerate(raw.split(b"\n")) if (s := x.strip())]


def fingerprints(hashes: np.ndarray, words: np.ndarray, least: int, second: np.ndarray | None = None) -> dict[int, list[tuple[int, int, int]]]:
    """Selected line -> the windows (first, last line, hash of contents) that select it.

    Lines are selected by ``hashes``, contents are hashed from ``second``, independent hashes of
    the lines: windows that are joined by contents are compared by ``hashes`` again."""
    import xxhash

    second = hashes if second is None else second
    out: dict[int, list] = {}
    upto = np.concatenate([[0], np.cumsum(words)])
    unsigned = hashes.view(np.uint64)
    ends = np.flatnonzero(upto[1:] >= least)
    starts = np.searchsorted(upto, upto[ends + 1] - least, "right") - 1
    for i, j in zip(starts.tolist(), ends.tolist()):
        part = unsigned[i : j + 1]
        pick = j - int(part[::-1].argmin())  # the last of equal ones
        out.setdefault(pick, []).append((i, j, xxhash.xxh3_64_intdigest(second[i : j + 1].tobytes()) - (1 << 63)))
    return out


def leads(hashes: np.ndarray, upto: np.ndarray, i: int, j: int, least: int) -> list[int]:
    """Hashes of contents of the runs from before line i to j, the shortest first, of which j ends
    the first window: those with fewer than ``least`` words before line j."""
    import xxhash

    out, unsigned = [], hashes.view(np.uint64)
    while i > 0 and upto[j] - upto[i - 1] < least:
        i -= 1
        out.append(xxhash.xxh3_64_intdigest(unsigned[i : j + 1].tobytes()) - (1 << 63))
    return out


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def _keyed(docs: DataFrame) -> DataFrame:
    """Key of a document: its id (the least integer for null) and a hash of its text."""
    return docs.withColumn("did", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn("th", F.xxhash64("text"))


def _lines(batches, least: int):
    import xxhash

    window = pa.struct([("i", pa.int32()), ("j", pa.int32()), ("wh", pa.int64()), ("leads", pa.list_(pa.int64()))])
    mark = pa.struct([("fh", pa.int64()), ("wins", pa.list_(window))])
    schema = pa.schema([("did", pa.int64()), ("th", pa.int64()), ("hs", pa.list_(pa.int64())), ("marks", pa.list_(mark))])
    for b in common.batched(batches, "text", LINES_BYTES):
        rows = []
        for did, th, text in zip(b.column("did").to_pylist(), b.column("th").to_pylist(), b.column("text")):
            lines = [s for _, s in lines_of(text.as_py())]
            h = np.array([_signed(xxhash.xxh3_64_intdigest(s)) for s in lines], np.int64)
            second = np.array([_signed(xxhash.xxh3_64_intdigest(s, seed=1)) for s in lines], np.int64)
            w = np.array([len(s.split()) for s in lines], np.int64)
            upto = np.concatenate([[0], np.cumsum(w)])
            marks = [{"fh": int(h[p]), "wins": [{"i": i, "j": j, "wh": x, "leads": leads(second, upto, i, j, least)} for i, j, x in wins]} for p, wins in fingerprints(h, w, least, second).items()]
            rows.append({"did": did, "th": th, "hs": h, "marks": marks})
        yield pa.RecordBatch.from_pylist(rows, schema)


def extend(mine: np.ndarray, first: np.ndarray, i: int, j: int, o: int, same: bool) -> tuple[int, int] | None:
    """The run of ``mine`` around lines i to j that equals ``first`` around o, as far as it goes;
    None if the lines themselves differ. Within one document the run does not reach into the
    one it repeats."""
    end = o + (j - i)
    if not np.array_equal(mine[i : j + 1], first[o : end + 1]):
        return None
    while i > 0 and o > 0 and mine[i - 1] == first[o - 1] and not (same and i - 1 <= end):
        i, o = i - 1, o - 1
    while j + 1 < len(mine) and end + 1 < len(first) and mine[j + 1] == first[end + 1] and not (same and end + 1 >= i):
        j, end = j + 1, end + 1
    return i, j


def repeated_runs(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """did, th and ``runs`` (array of first and last line, blank lines not counted) of documents
    with runs to delete. The first occurrence, by doc_id and position, is never among them."""
    spark = docs.sparkSession
    work = common.work_dir(spark, "lines")
    rows = _keyed(docs).select(*_KEY, "text")
    kind = "did long, th long, hs array<long>, marks array<struct<fh: long, wins: array<struct<i: int, j: int, wh: long, leads: array<long>>>>>"
    lines = common.stage(rows.mapInArrow(lambda batches: _lines(batches, least), kind), f"{work}/lines")

    # what hot keys are joined to is written first: a join of two plain shuffles is split by its skew
    marks = lines.select(*_KEY, F.explode("marks").alias("m")).select(*_KEY, "m.fh", "m.wins")
    often = common.stage(marks.groupBy("fh").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fh"), f"{work}/often")
    wins = marks.join(often, "fh").select(*_KEY, F.explode("wins").alias("w")).select(*_KEY, "w.i", "w.j", F.posexplode(F.concat(F.array("w.wh"), "w.leads")).alias("more", "wh"))
    wins = common.stage(wins.withColumn("i", F.col("i") - F.col("more")).drop("more"), f"{work}/wins")
    # a document that comes as several rows is one document: its windows are at the same lines
    first = wins.groupBy("wh").agg(F.min(F.struct("did", "th", "i")).alias("o"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = common.stage(first.select("wh", F.col("o.did").alias("odid"), F.col("o.th").alias("oth"), F.col("o.i").alias("oi")), f"{work}/first")
    hashes = lines.select(*_KEY, "hs")
    heads = first.select("odid", "oth").distinct().join(hashes.toDF("odid", "oth", "ohs"), ["odid", "oth"]).dropDuplicates(["odid", "oth"])
    heads = common.stage(heads, f"{work}/heads")
    met = wins.join(first, "wh").select(*_KEY, "odid", "oth", "i", "j", "oi")
    same = (F.col("did") == F.col("odid")) & (F.col("th") == F.col("oth"))
    met = met.where(~same | (F.col("i") > F.col("oi") + F.col("j") - F.col("i")))
    met = met.groupBy(*_KEY, "odid", "oth").agg(F.collect_set(F.struct("i", "j", "oi")).alias("hits"))
    met = met.join(hashes, list(_KEY)).join(heads, ["odid", "oth"])

    def grow(batches):
        for b in batches:
            out = {"did": b.column("did"), "th": b.column("th"), "runs": []}
            for did, th, odid, oth, hits, hs, ohs in zip(*(b.column(c) for c in ("did", "th", "odid", "oth", "hits", "hs", "ohs"))):
                same_doc = did.as_py() == odid.as_py() and th.as_py() == oth.as_py()
                mine, other = hs.values.to_numpy(), ohs.values.to_numpy()
                found = (extend(mine, other, h["i"], h["j"], h["oi"], same_doc) for h in hits.as_py())
                out["runs"].append([dict(zip("ij", x)) for x in found if x])
            out["runs"] = pa.array(out["runs"], pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32())])))
            yield pa.RecordBatch.from_pydict(out)

    runs = met.select("did", "th", "odid", "oth", "hits", "hs", "ohs").mapInArrow(grow, "did long, th long, runs array<struct<i: int, j: int>>")
    runs = runs.groupBy(*_KEY).agg(F.array_distinct(F.flatten(F.collect_set("runs"))).alias("runs"))
    return common.stage(runs, f"{work}/runs")


def _cut(text: str, runs: list[dict]) -> tuple[str, int, int]:
    """The text without the runs and the blank lines within them; lines and words removed."""
    raw = text.encode("utf-8", "surrogatepass").split(b"\n")
    full = [i for i, x in enumerate(raw) if x.strip()]
    gone, lines, words = np.zeros(len(raw), bool), np.zeros(len(full), bool), 0
    for r in runs:
        gone[full[r["i"]] : full[r["j"]] + 1] = True
        lines[r["i"] : r["j"] + 1] = True
    words = sum(len(raw[full[i]].split()) for i in np.flatnonzero(lines))
    return b"\n".join(x for x, g in zip(raw, gone) if not g).decode("utf-8", "surrogatepass"), int(lines.sum()), words


def dedup_lines(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """``docs`` (doc_id, text, ...) with later repeated runs of lines of at least ``least``
    words deleted from the texts, and columns n_lines, removed_lines and removed_words.

    Lines are compared without white space at their ends; blank lines do not count. Of
    equal runs the first stays: by doc_id (null first), a hash of the text, and position.
    A run that repeats within its own document stays once, and what overlaps it stays.
    Rows that agree in doc_id and text are one document and are treated alike. Texts
    without a repeated run, null and empty texts are returned unchanged; texts of any
    length are read whole. An empty table gives an empty result. Other columns are kept; a
    column that is called like one of the three is replaced.
    """
    extra = ("n_lines", "removed_lines", "removed_words")
    base = docs.drop(*extra)
    did, th, found = common.fresh(base, "_did", "_th", "_runs")
    runs = repeated_runs(base.select("doc_id", "text"), least).withColumnsRenamed({"did": did, "th": th, "runs": found})
    key = (F.coalesce(base["doc_id"].cast("long"), F.lit(-(1 << 63))) == F.col(did)) & (F.xxhash64(base["text"]) == F.col(th))
    # one plan at every size: both sides are plain shuffles, which are split by their skew
    joined = base.join(runs.hint("merge"), key, "left").drop(did, th)

    def run(batches):
        for b in common.batched(batches, "text", BATCH_BYTES):
            texts, n, lines, words = [], [], [], []
            for t, r in zip(b.column("text"), b.column(found)):
                t, r = t.as_py(), r.as_py()
                n.append(len(lines_of(t)))
                t, removed, w = _cut(t, r) if r else (t, 0, 0)
                texts.append(t)
                lines.append(removed)
                words.append(w)
            at = b.schema.get_field_index("text")
            b = b.set_column(at, "text", pa.array(texts, b.schema.field(at).type)).drop_columns([found])
            for name, x in zip(extra, (n, lines, words)):
                b = b.append_column(name, pa.array(x, pa.int64()))
            yield b

    schema = StructType(list(base.schema))
    for name in extra:
        schema = schema.add(name, "long")
    return joined.mapInArrow(run, schema)
