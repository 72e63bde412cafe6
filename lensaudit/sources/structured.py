"""JSON-LD blocks to items, types and errors.

Blocks are read as variants in the JVM. Pages with a block that is malformed, repeats a
key or is nested deeper than LEVELS are read by Python's parser, which words the errors.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARSED = "struct<blocks: int, parsed: int, types: array<string>, errors: array<string>, items: array<string>>"
#: Lists and @graph arrays in each other that are unwrapped by variants.
LEVELS = 4


def flatten(data) -> list:
    """Objects in lists and @graph arrays, at any depth."""
    if isinstance(data, list):
        return [x for d in data for x in flatten(d)]
    if isinstance(data, dict) and isinstance(data.get("@graph"), list):
        return flatten(data["@graph"])
    return [data]


def parse_blocks(blocks: list[str | None] | None) -> dict:
    """Items of all blocks in order, as JSON; empty and invalid blocks are errors. Of repeated
    keys the last holds."""
    items, types, errors = [], [], []
    for i, raw in enumerate(blocks or []):
        if not (raw or "").strip():
            errors.append(f"block {i}: empty")
            continue
        try:
            data = json.loads(raw)
        except ValueError as e:
            errors.append(f"block {i}: {e}")
            continue
        for item in flatten(data):
            if isinstance(item, dict):
                items.append(json.dumps(item, ensure_ascii=False))
                kind = item.get("@type")
                types += [k for k in (kind if isinstance(kind, list) else [kind]) if isinstance(k, str)]
    return {"blocks": len(blocks or []), "parsed": len(items), "types": types, "errors": errors, "items": items}


def _let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _list(v: Column) -> Column:
    """The elements of a list, or of the list at @graph; null for anything else."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$['@graph']", "array<variant>"))


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def _strict(raw: Column) -> Column:
    """A block as a variant; null if it is anything but one JSON value. What follows a first value
    cannot pass both as the rest of a list of one and as the rest of an object."""
    alone = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]"))), "$", "array<variant>")
    member = F.try_parse_json(F.concat(F.lit('{"v":'), raw, F.lit("}")))
    return F.when(member.isNotNull(), _let(alone, lambda a: F.when(F.size(a) == 1, F.get(a, F.lit(0)))))


def _strings(v: Column) -> Column:
    """A string, or the strings of a list, of a variant."""
    one = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))
    values = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))
    return F.filter(F.transform(values, one), lambda x: x.isNotNull())


def _in_jvm(blocks: Column) -> Column:
    """The parsed struct with ``left``: the page is to be read by Python."""
    texts = F.coalesce(F.transform(blocks, lambda b: F.coalesce(b, F.lit(""))), F.array().cast("array<string>"))
    blank = lambda b: ~b.rlike(r"(?U)\S")
    empties = F.filter(F.transform(texts, lambda b, i: F.when(blank(b), F.concat(F.lit("block "), i.cast("string"), F.lit(": empty")))), lambda e: e.isNotNull())

    def read(values: Column) -> Column:
        flat = F.filter(values, lambda v: v.isNotNull())
        for _ in range(LEVELS):
            flat = F.flatten(F.transform(flat, lambda v: F.coalesce(_list(v), F.array(v))))
        bad = F.size(F.filter(values, lambda v: v.isNull())) > F.size(empties)

        def result(flat: Column) -> Column:
            objects = F.filter(flat, is_object)
            types = F.flatten(F.transform(objects, lambda v: _strings(F.try_variant_get(v, "$['@type']", "variant"))))
            return F.struct(F.size(texts).alias("blocks"), F.size(objects).alias("parsed"), types.alias("types"), empties.alias("errors"), F.transform(objects, lambda v: F.to_json(v)).alias("items"), (bad | F.exists(flat, lambda v: _list(v).isNotNull())).alias("left"))

        return _let(flat, result)

    return _let(F.transform(texts, _strict), read)


def parse(rows: DataFrame, blocks: str, name: str) -> DataFrame:
    """``rows`` with a struct ``name`` of what the array ``blocks`` says, in its place: blocks, parsed, types,
    errors, items (JSON objects). Null is no block; a null block is an empty one."""
    kept = [c for c in rows.columns if c != blocks]
    rows = rows.select(*kept, F.col(blocks).alias("_blocks"), _in_jvm(F.col(blocks)).alias("_jvm"))
    reader = F.udf(parse_blocks, PARSED, useArrow=True).asNondeterministic()  # filters on its result stay above it
    rows = rows.withColumn("_python", reader(F.when(F.col("_jvm.left"), F.col("_blocks"))))
    read = F.struct(*(F.col(f"_jvm.{c}").alias(c) for c in ("blocks", "parsed", "types", "errors", "items")))
    return rows.select(*kept, F.when(F.col("_jvm.left"), F.col("_python")).otherwise(read).alias(name))


def first_value(item: Column, key: str) -> Column:
    """A member of a JSON object as text, of a list its first element; null without one."""
    value = F.try_variant_get(F.try_parse_json(item), f"$['{key}']", "variant")
    return F.coalesce(F.try_variant_get(value, "$[0]", "string"), F.when(F.try_variant_get(value, "$", "array<variant>").isNull(), F.try_variant_get(value, "$", "string")))


def find_items_with(items: Column, keys) -> Column:
    """The items that have any of some keys, whatever is there."""
    def has(v: Column) -> Column:
        out = F.lit(False)
        for key in keys:
            out = out | F.array_contains(F.map_keys(F.coalesce(v, F.create_map().cast("map<string,variant>"))), key)
        return out

    return F.filter(items, lambda i: _let(F.try_variant_get(F.try_parse_json(i), "$", "map<string,variant>"), has))


def names(items: Column) -> Column:
    """Stripped name and legalName of each item, in order, where they are text."""
    def of(item: Column) -> Column:
        return F.filter(F.array(*(F.trim(text_at(item, key)) for key in ("name", "legalName"))), lambda n: n != "")

    return F.flatten(F.transform(items, of))


def text_at(item: Column, key: str) -> Column:
    """A string member of an item; null if it is missing, empty or of another kind."""
    raw = F.get_json_object(item, f"$['{key}']")
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(item), f"$['{key}']", "variant"))
    return F.when(kind == "STRING", F.nullif(raw, F.lit("")))
