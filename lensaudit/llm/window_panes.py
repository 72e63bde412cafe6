"""Window panes with revisions, settled by punctuation that travels with the rows.

A pane is a kind and an hour of event time. Batches of rows go into a stateful streaming query,
started anew for each on one checkpoint. With each batch, even an empty one, comes a control row
for every state shard: W (the largest event time of all earlier batches) and whether it is the
last. A shard first adds the batch to its panes (a MapState), then the control row settles them:
totals are emitted when due, corrected when later rows change them, and forgotten when closed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from . import common

HOUR = 3_600_000_000
DAY = 24 * HOUR
#: A pane is due so long after its end, and closed so long after it.
DUE, CLOSED = 6 * HOUR, 4 * DAY
#: Groups of panes that are kept and settled together.
SHARDS = 64
#: Panes a task adds up before it passes them on.
HELD = 100_000
NEVER = -(1 << 63)

RECORDS = "batch long, hour long, click_id long, n_rows long, cents long, record string, kind string"
_FED = "batch long, w long, shard int, last boolean, click_id long, kind string, hour long, cents long"
_DEALT = "shard int, what string, batch long, w long, last boolean, click_id long, kind string, hour long, n_rows long, cents long"
#: State is written whole to the shared folder at each commit; what stays on a worker's own disk is let go.
_CONFS = {
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def cut(clicks: DataFrame, batches: int = 8) -> DataFrame:
    """batch, click_id, kind, at (event time in microseconds since 1970) and cents of each click.

    Rows without ts are dropped. Of rows with one click_id that of the least arrived_at, ts, kind and
    value stays; null ids are one id, whose text is empty. With D the day of arrived_at (null: of
    ts) and q = D mod batches, a click is in batch q or, by crc32 of its id, up to six later, and its event
    time is ts minus D - q days. A null kind is ``none``; cents are rounded half up, 0 for null values
    and those that are not finite or leave a long.
    """
    rows = clicks.where(F.col("ts").isNotNull()).select("click_id", F.struct(*(F.col(c).cast("timestamp_ntz").alias(c) for c in ("arrived_at", "ts")), F.col("kind").cast("string").alias("kind"), F.col("value").cast("double").alias("value")).alias("r"))
    one = rows.groupBy("click_id").agg(F.min("r").alias("r")).select("click_id", "r.*")
    day = F.unix_date(F.coalesce("arrived_at", "ts").cast("date")).cast("long")
    q = F.pmod(day, F.lit(batches))
    code = F.crc32(F.coalesce(F.col("click_id").cast("string"), F.lit("")).cast("binary")) % 30
    scaled = F.floor(F.col("value") * 100 + 0.5)
    fits = F.abs(F.col("value")) < 9e16  # false for NaN and infinities, which are greater
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return one.select(
        F.least(F.lit(batches - 1).cast("long"), q + F.greatest(F.lit(0).cast("long"), code - 23)).alias("batch"), F.col("click_id").cast("long").alias("click_id"),
        F.coalesce("kind", F.lit("none")).alias("kind"), (us - (day - q) * DAY).alias("at"), F.when(fits, scaled).otherwise(0).cast("long").alias("cents"),
    )


def _shard(text: str, shards: int) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % shards


def _dealer(shards: int):
    """Rows to shards: totals of this task's rows for each open pane, so that a pane with many
    rows is no single task's work, and late rows, which meet no pane, by their ids."""
    names = [f.split(" ")[0] for f in _DEALT.split(", ")]

    def out(cols: dict, n: int) -> pa.RecordBatch:
        types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
        kinds = dict(f.split(" ") for f in _DEALT.split(", "))
        return pa.RecordBatch.from_arrays([pa.array(cols[c], types[kinds[c]]) if c in cols else pa.nulls(n, types[kinds[c]]) for c in names], names)

    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        if held:
            keys, sums = list(held), list(held.values())
            yield out({"shard": [_shard(f"{k}:{h}", shards) for _, k, h in keys], "what": ["rows"] * len(keys), "batch": [k[0] for k in keys], "kind": [k[1] for k in keys], "hour": [k[2] for k in keys], "n_rows": [s[0] for s in sums], "cents": [s[1] for s in sums]}, len(keys))
            held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str, int], tuple[int, int]] = {}
        for b in batches:
            t = pa.Table.from_batches([b])
            control = t.filter(pc.is_valid(t["shard"]))
            if control.num_rows:
                yield out({c: control[c].combine_chunks() for c in ("shard", "batch", "w", "last")} | {"what": ["control"] * control.num_rows}, control.num_rows)
            t = t.filter(pc.is_null(t["shard"]))
            if not t.num_rows:
                continue
            late = _is_late(t["hour"], t["w"])
            gone = t.filter(late)
            if gone.num_rows:
                ids = gone["click_id"].combine_chunks()
                yield out({"shard": [_shard(str(x), shards) for x in ids.to_pylist()], "what": ["late"] * len(ids), "n_rows": [1] * len(ids), "click_id": ids} | {c: gone[c].combine_chunks() for c in ("batch", "kind", "hour", "cents")}, len(ids))
            t = t.filter(pc.invert(late))
            sums = t.group_by(["batch", "kind", "hour"]).aggregate([("cents", "sum"), ([], "count_all")])
            for *pane, cents, n in zip(*(sums[c].to_pylist() for c in ("batch", "kind", "hour", "cents_sum", "count_all"))):
                was = held.get(tuple(pane), (0, 0))
                held[tuple(pane)] = (was[0] + n, was[1] + cents)
            if len(held) > HELD:
                yield from flush(held)
        yield from flush(held)

    return run


def _is_late(hour: pa.ChunkedArray, w: pa.ChunkedArray) -> pa.ChunkedArray:
    end = pc.multiply(pc.add(hour, 1), HOUR)
    return pc.greater_equal(w, pc.add(end, CLOSED))


class Panes(StatefulProcessor):
    """The panes of a shard: pane to (rows, cents, whether emitted)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.panes = handle.getMapState("panes", "kind string, hour long", "n_rows long, cents long, emitted boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        added: dict[tuple[str, int], list[int]] = {}
        control = None
        for pdf in rows:
            late = pdf[pdf["what"] == "late"]
            if len(late):
                yield _records(zip(late["batch"], late["hour"], late["click_id"], late["n_rows"], late["cents"], ["late"] * len(late), late["kind"]))
            for r in pdf[pdf["what"] == "control"].itertuples():
                control = int(r.batch), int(r.w), bool(r.last)
            new = pdf[pdf["what"] == "rows"]
            for kind, hour, n, cents in zip(new["kind"], new["hour"], new["n_rows"], new["cents"]):
                sums = added.setdefault((kind, int(hour)), [0, 0])
                sums[0] += int(n)
                sums[1] += int(cents)
        panes = {(k, int(h)): (int(n), int(c), bool(e)) for (k, h), (n, c, e) in self.panes.iterator()}
        was = {p: panes.get(p, (0, 0, False)) for p in added}
        for p, (n, cents) in added.items():
            panes[p] = (was[p][0] + n, was[p][1] + cents, was[p][2])
        changed = set(added)
        if control:
            batch, w, last = control
            said = []
            for (kind, hour), (n, cents, emitted) in sorted(panes.items()):
                end = (hour + 1) * HOUR
                tell = lambda record, n=n, cents=cents: said.append((batch, hour, -1, n, cents, record, kind))  # noqa: B023, E731
                if emitted and (kind, hour) in added:
                    tell("retract", *was[kind, hour][:2])
                    tell("replace")
                elif not emitted and (w >= end + DUE or last):
                    tell("emit" if w >= end + DUE else "final")
                    panes[kind, hour] = (n, cents, True)
                    changed.add((kind, hour))
                if w >= end + CLOSED:
                    del panes[kind, hour]
                    changed.add((kind, hour))
            yield _records(said)
        for p in changed:
            if p in panes:
                self.panes.updateValue(p, panes[p])
            elif self.panes.containsKey(p):
                self.panes.removeKey(p)

    def close(self) -> None:
        pass


def _records(rows) -> pd.DataFrame:
    out = pd.DataFrame(list(rows), columns=[f.split(" ")[0] for f in RECORDS.split(", ")])
    return out.astype({"batch": "int64", "hour": "int64", "n_rows": "int64", "cents": "int64", "click_id": "Int64"})


def _controls(spark: SparkSession, batch: int, w: int, last: bool, shards: int) -> DataFrame:
    fixed = (F.lit(batch).cast("long").alias("batch"), F.lit(w).cast("long").alias("w"), F.col("id").cast("int").alias("shard"), F.lit(last).alias("last"))
    empty = (F.lit(None).cast(t).alias(c) for c, t in (("click_id", "long"), ("kind", "string"), ("hour", "long"), ("cents", "long")))
    return spark.range(0, shards, 1, 1).select(*fixed, *empty)


def run(rows: DataFrame, root: str, batches: int, shards: int = SHARDS) -> DataFrame:
    """The records (batch, hour, click_id, n_rows, cents, record, kind) of all ``batches``.

    ``rows`` has batch (0 to batches - 1), click_id, kind, at and cents, as ``cut`` gives them; ``root`` is a new
    folder that driver and executors share. Rows of panes that are closed are ``late``, one
    record each; all others are added to their panes, then due panes are told as ``emit``,
    panes told before whose totals changed as ``retract`` and ``replace``, and in the last batch the
    rest as ``final``. A late row's null id stays null. Rows that repeat count each; an empty table gives an
    empty result. Only the largest event time of each batch comes to the driver.
    """
    spark = rows.sparkSession
    hour = F.expr(f"(at - pmod(at, {HOUR}L)) div {HOUR}L")
    cutup = common.stage(rows.select("batch", "click_id", "kind", hour.alias("hour"), "at", "cents"), f"{root}/cut", partition_by=["batch"])
    most = {r["batch"]: r["w"] for r in cutup.groupBy("batch").agg(F.max("at").alias("w")).collect()}
    confs = _CONFS | {"spark.sql.shuffle.partitions": str(min(shards, common.shuffle_partitions(spark)))}  # a shard is one key
    was = {k: spark.conf.get(k, None) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        w = NEVER
        for b in range(batches):
            mine = cutup.where(F.col("batch") == b).select(F.col("batch").cast("long").alias("batch"), F.lit(w).cast("long").alias("w"), F.lit(None).cast("int").alias("shard"), F.lit(None).cast("boolean").alias("last"), "click_id", "kind", "hour", "cents")
            mine.union(_controls(spark, b, w, b == batches - 1, shards)).write.mode("append").parquet(f"{root}/fed")
            _settle(spark, root, shards)
            w = max(w, most.get(b, NEVER))
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(RECORDS).parquet(f"{root}/records")


def _settle(spark: SparkSession, root: str, shards: int) -> None:
    """One start of the query: what came since the last one, then it ends."""
    fed = spark.readStream.schema(_FED).parquet(f"{root}/fed")
    dealt = fed.mapInArrow(_dealer(shards), _DEALT)
    told = dealt.groupBy("shard").transformWithStateInPandas(Panes(), RECORDS, "Append", "None")
    told.writeStream.format("parquet").option("path", f"{root}/records").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
