"""Conforming values in parallel, by hashes of (seed, row, attempt, pointer): recomputed tasks give the same rows."""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlake.functions.pattern_text import pattern_text, quoted
from pactlake.functions.predicates import compile_contract
from pactlake.functions.settled import settle
from pactlake.functions.values import Variant, once

_FORMATS = {
    "date": lambda h: F.date_format(F.date_add(F.lit("2000-01-01"), F.pmod(h, F.lit(9000)).cast("int")), "yyyy-MM-dd"),
    "date-time": lambda h: F.date_format(F.timestamp_seconds(F.pmod(h, F.lit(1_700_000_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    "time": lambda h: F.date_format(F.timestamp_seconds(F.pmod(h, F.lit(86_400))), "HH:mm:ss'Z'"),
    "email": lambda h: F.concat(F.lit("u"), F.hex(h), F.lit("@example.com")),
    "uri": lambda h: F.concat(F.lit("https://example.com/"), F.hex(h)),
    "uuid": lambda h: F.regexp_replace(F.md5(F.hex(h)), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
    "ipv4": lambda h: F.concat_ws(".", *(F.pmod(F.shiftrightunsigned(h, 8 * i), F.lit(256)).cast("string") for i in range(4))),
    "ipv6": lambda h: F.regexp_replace(F.md5(F.hex(h)), r"(.{4})(?!$)", "$1:"),
    "hostname": lambda h: F.concat(F.lit("h"), F.lower(F.hex(h)), F.lit(".example.com")),
}


def uniform(seed: int, pointer: str, *row: Column) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(pointer), *row)


def hashed_between(h: Column, lo: Column, hi: Column) -> Column:
    """A whole number from lo to hi."""
    return lo + F.pmod(h, F.greatest(hi - lo + 1, F.lit(1)))


def value_json(schema, seed: int, row: list[Column], pointer: str = "#", depth: int = 5) -> Column:
    """JSON text of a value that aims at the schema; what it misses is left to the filter of generate()."""
    h = uniform(seed, pointer, *row)
    if schema is True or not isinstance(schema, Mapping) or depth < 0:
        return F.lit("null")
    if "const" in schema:
        return F.lit(json.dumps(schema["const"]))
    if "enum" in schema:
        return F.element_at(F.array(*(F.lit(json.dumps(x)) for x in schema["enum"])), (F.pmod(h, F.lit(len(schema["enum"]))) + 1).cast("int"))
    for k in ("anyOf", "oneOf"):
        if k in schema:
            rest = {x: y for x, y in schema.items() if x != k}
            own = [value_json({**rest, **b} if isinstance(b, Mapping) else rest, seed, row, f"{pointer}/{k}/{i}", depth - 1) for i, b in enumerate(schema[k])]
            return F.element_at(F.array(*own), (F.pmod(h, F.lit(len(own))) + 1).cast("int"))
    if "allOf" in schema:
        merged: dict = {k: v for k, v in schema.items() if k != "allOf"}
        for b in schema["allOf"]:
            merged = {**merged, **b, "properties": {**merged.get("properties", {}), **b.get("properties", {})}, "required": [*merged.get("required", []), *b.get("required", [])]}
        return value_json({k: v for k, v in merged.items() if v not in ({}, [])}, seed, row, pointer, depth)
    kind = schema.get("type") or ("object" if "properties" in schema else "array" if "items" in schema else "string" if "minLength" in schema or "pattern" in schema else "number" if "minimum" in schema else "null")
    if isinstance(kind, list):
        own = [value_json({**schema, "type": t}, seed, row, f"{pointer}/{t}", depth - 1) for t in kind]
        return F.element_at(F.array(*own), (F.pmod(h, F.lit(len(own))) + 1).cast("int"))
    if kind == "boolean":
        return F.when(F.pmod(h, F.lit(2)) == 0, "true").otherwise("false")
    if kind in ("integer", "number"):
        lo, hi = schema.get("minimum", schema.get("exclusiveMinimum", max(-1000, schema.get("maximum", 0) - 1000))), schema.get("maximum", schema.get("exclusiveMaximum"))
        hi = lo + 1000 if hi is None else hi
        step = schema.get("multipleOf", 1 if kind == "integer" else None)
        if step:
            first, last = -(-lo // step), hi // step
            n = hashed_between(h, F.lit(int(first)), F.lit(int(last)))
            return (n * step).cast("string") if isinstance(step, int) else (n * F.lit(step)).cast("decimal(30,6)").cast("string")
        return (F.lit(float(lo)) + F.pmod(h, F.lit(1_000_001)) / 1_000_000 * float(hi - lo)).cast("decimal(30,6)").cast("string")
    if kind == "string":
        if schema.get("format") in _FORMATS:
            return F.concat(F.lit('"'), _FORMATS[schema["format"]](h), F.lit('"'))
        lo, hi = schema.get("minLength", 0), schema.get("maxLength", schema.get("minLength", 0) + 10)
        n = hashed_between(h, F.lit(lo), F.lit(min(hi, lo + 10)))
        many = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(lo // 32 + 1)), lambda i: F.md5(F.concat(F.hex(h), i.cast("string")))), "")
        plain = F.concat(F.lit('"'), F.substr(many, F.lit(1), n.cast("int")), F.lit('"'))
        if "pattern" not in schema:
            return plain
        return F.coalesce(quoted(pattern_text(F.lit(schema["pattern"]), F.lit(lo), F.lit(schema.get("maxLength")).cast("int"), h)), plain)
    if kind == "array":
        lo, hi = schema.get("minItems", 0), schema.get("maxItems", schema.get("minItems", 0) + 3)
        n = hashed_between(h, F.lit(lo), F.lit(hi)).cast("int")
        own = [value_json(s, seed, row, f"{pointer}/prefixItems/{i}", depth - 1) for i, s in enumerate(schema.get("prefixItems", []))]
        own += [value_json(schema.get("items", True), seed, row, f"{pointer}/items/{i}", depth - 1) for i in range(len(own), hi)]
        items = F.slice(F.array(*own), F.lit(1), n) if own else F.array().cast("array<string>")
        items = F.array_distinct(items) if schema.get("uniqueItems") else items
        return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
    if kind == "object":
        needed = set(schema.get("required", ()))
        parts = []
        for k, s in schema.get("properties", {}).items():
            field = F.concat(F.lit(json.dumps(k) + ":"), value_json(s, seed, row, f"{pointer}/properties/{k}", depth - 1))
            parts.append(field if k in needed else F.when(F.pmod(uniform(seed, f"{pointer}?{k}", *row), F.lit(2)) == 0, field))
        return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}")) if parts else F.lit("{}")
    return F.lit("null")


def generate(spark: SparkSession, schema, n: int, seed: int = 42, depth: int = 5, attempts: int = 100) -> DataFrame:
    """(id, value JSON or NULL, tried, status) for ids 0 to n - 1."""
    return generate_for(spark.range(n), ["id"], schema, seed, depth, attempts)


def generate_for(rows: DataFrame, keys: list[str], schema, seed: int = 42, depth: int = 5, attempts: int = 100) -> DataFrame:
    """(keys..., value, tried, status) for different keys: the first attempt that the contract accepts (found), or NULL:
    unsatisfiable if the contract accepts nothing by what it says, else exhausted after all attempts. Attempts are made
    in rounds of 4, 16, 64, ..., each for the rows that have no value yet."""
    fits = compile_contract(schema, Variant(F.col("_v")))
    never = schema is False or (isinstance(schema, Mapping) and schema.get("enum") == [])
    open_rows, done, first = rows.select(*keys), [], 0
    while first < attempts and not never:
        last = min(attempts, first * 4 + 4)
        tries = open_rows.withColumn("attempt", F.explode(F.sequence(F.lit(first), F.lit(last - 1))))
        made = tries.withColumn("value", value_json(schema, seed, [*map(F.col, keys), F.col("attempt")], depth=depth))
        hit = once(made, "_v", F.try_parse_json("value")).filter(F.coalesce(fits, F.lit(False)))
        hit = settle(hit.groupBy(*keys).agg(F.min(F.struct("attempt", "value")).alias("w")).select(*keys, "w.value", (F.col("w.attempt") + 1).alias("tried")))
        done.append(hit.withColumn("status", F.lit("found")))
        open_rows, first = settle(open_rows.join(hit, keys, "left_anti")), last
        if open_rows.isEmpty():
            break
    left = open_rows.select(*keys, F.lit(None).cast("string").alias("value"), F.lit(first).alias("tried"), F.lit("unsatisfiable" if never else "exhausted").alias("status"))
    return reduce(DataFrame.unionByName, [*done, left])
