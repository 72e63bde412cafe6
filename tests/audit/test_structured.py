"""JSON-LD by variants against Python's reader."""

import json
import random

from pyspark.sql import functions as F

from lensaudit.sources import structured as S

ODD = [
    None, [], [None], ["", " \n", " "], ["{}"], ["3", "null", '"x"', "[]"], ["{} x"], ["1 2"], ["{}, {}"], ["{}],[x"], ['{}},{"x"'], ["{bad,}", '{"@type":"A"}'],
    ['{"a":1,"a":2,"@type":"A"}'], ['{"@type":["B",3,null,["C"],"D"]}'], ['{"@type":null}', '{"@type":{"x":1}}'], ['{"@graph":{"k":1},"@type":"G"}'], ['{"@graph":[],"@type":"G"}'],
    ["[" * 9 + '{"@type":"Deep"}' + "]" * 9], ["[" * 3 + '{"@graph":[{"@type":"Flat"}]}' + "]" * 3], ['{"a":{"b":[1,{"c":null}]},"n":"é \\" \\\\ \\n"}'], ["﻿{}"], ["NaN"], ["01"],
]


def _value(rng, depth):
    kind = rng.randrange(6 if depth else 3)
    if kind == 3:
        return [_value(rng, depth - 1) for _ in range(rng.randrange(4))]
    if kind == 4:
        return {"@graph": [_value(rng, depth - 1) for _ in range(rng.randrange(3))]} | ({"@type": "G"} if rng.random() < 0.3 else {})
    if kind == 5:
        return {"@type": rng.choice(["A", ["B", "C"], 1, []]), "name": rng.choice(["n", " m ", "", 4, None]), "legalName": "l", "x": _value(rng, depth - 1)}
    return rng.choice([1, "s", None, True, {}])


def test_variants_read_what_python_reads(spark):
    rng = random.Random(11)
    cases = ODD + [[json.dumps(_value(rng, 6)) for _ in range(rng.randrange(3))] for _ in range(150)]
    df = spark.createDataFrame([(i, c, "kept") for i, c in enumerate(cases)], "i int, b array<string>, blocks string").repartition(2)
    got = {r.i: r for r in S.parse(df, "b", "ld").collect()}
    for i, c in enumerate(cases):
        want, ld = S.parse_blocks(c), got[i].ld
        assert (ld.blocks, ld.parsed, ld.types, ld.errors) == (want["blocks"], want["parsed"], want["types"], want["errors"]), c
        assert [json.loads(x) for x in ld.items] == [json.loads(x) for x in want["items"]], c
    assert got[0].blocks == "kept"


def test_python_gets_only_what_is_left(spark):
    df = spark.createDataFrame([(c,) for c in ODD], "b array<string>").select("b", S._in_jvm(F.col("b")).alias("j"))
    left = {json.dumps(r.b) for r in df.where("j.left").collect()}
    assert left == {json.dumps(ODD[i]) for i in (6, 7, 8, 9, 10, 11, 12, 17, 20, 21, 22)}


def test_keys_names_and_first_values(spark):
    items = ['{"name":" A ","legalName":"B","k":null}', '{"name":3,"list":["x","y"]}', '{"name":" ","list":[]}', '{"deep":{"k":1},"one":7}']
    df = spark.createDataFrame([(items,)], "items array<string>")
    first = lambda i, key: S.first_value(F.get("items", F.lit(i)), key)
    r = df.select(S.names(F.col("items")).alias("names"), S.find_items_with(F.col("items"), ("k", "list")).alias("found"), first(1, "list").alias("a"), first(2, "list").alias("b"), first(3, "one").alias("c"), first(3, "none").alias("d")).collect()[0]
    assert (r.names, r.found) == (["A", "B"], items[:3])
    assert (r.a, r.b, r.c, r.d) == ("x", None, "7", None)
    assert df.limit(0).select(S.names(F.col("items"))).collect() == []
