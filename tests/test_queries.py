"""Every query that has DuckDB SQL gives the same rows; the others give rows."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return tuple(map(_norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(_norm(r[c]) for c in cols)) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got or name == "block_stream"
        return
    rel = duck.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(repr(tuple(_norm(r[i]) for i in at)) for r in rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_name_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_block_stream_has_all_windows(spark):
    from pyspark.sql import functions as F

    from lensaudit.plans import queries, simulate
    from lensaudit.streaming import incremental

    rows = simulate.fetches(queries._pages(spark, SF)).withColumn("fetched_at", F.expr("timestamp'2025-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, pos)"))
    want = sorted(map(tuple, incremental.block_rates(rows, window="10 seconds").collect()))
    assert want and sorted(map(tuple, entry.queries()["block_stream"](spark, SF).collect())) == want
