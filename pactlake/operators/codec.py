"""Typed decode and encode of JSON records: undeclared keys kept apart, missing kept apart from null."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactlake.functions.predicates import compile_contract
from pactlake.functions.values import EXACT, Variant, once

_PLAIN = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "null": T.NullType()}


def type_of(schema) -> T.DataType:
    """The Spark type of a contract's values; VARIANT where it doesn't say one."""
    kind = schema.get("type") if isinstance(schema, Mapping) else None
    if isinstance(kind, list):
        return T.VariantType()
    if kind in _PLAIN:
        return _PLAIN[kind]
    if kind == "array":
        return T.ArrayType(type_of(schema.get("items", {})))
    if kind == "object" and schema.get("properties"):
        return to_struct_type(schema)
    return T.MapType(T.StringType(), T.VariantType()) if kind == "object" else T.VariantType()


def to_struct_type(schema: Mapping) -> T.StructType:
    required = set(schema.get("required", ()))
    return T.StructType([T.StructField(k, type_of(s), k not in required) for k, s in schema.get("properties", {}).items()])


def decode(df: DataFrame, json_col: str, schema: Mapping, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """(typed rows, rejected rows). Typed: keep..., a column per property, present ARRAY of declared keys that occur
    (with null too), and extra MAP of undeclared ones (empty where the contract is closed). Rejected: text that is no
    JSON (duplicate keys, NaN), not valid, or deeper than a recursive contract is unrolled. Whole numbers beyond 64 bits
    decode to NULL in a BIGINT column."""
    parsed = once(df, "_v", F.try_parse_json(json_col))
    flagged = parsed.withColumn("_ok", F.col("_v").isNotNull() & F.coalesce(compile_contract(schema, Variant(F.col("_v"))), F.lit(False)))
    props = schema.get("properties", {})
    good = once(flagged.filter("_ok"), "_m", F.try_variant_get("_v", "$", "map<string,variant>"))
    fields = [_field(F.try_element_at("_m", F.lit(k)), type_of(s)).alias(k) for k, s in props.items()]
    declared = F.array(*map(F.lit, props)).cast("array<string>")
    present = F.array_intersect(declared, F.coalesce(F.map_keys("_m"), F.array().cast("array<string>"))).alias("present")
    extra = F.map_filter("_m", lambda k, _: ~F.array_contains(declared, k)).alias("extra")
    return good.select(*keep, *fields, present, extra), flagged.filter("NOT _ok").select(*keep, json_col)


def _field(v: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.VariantType):
        return v
    if isinstance(kind, T.LongType):  # 7.0 and 1e3 are whole numbers too, but not by way of a double where it has more digits
        return F.when(F.schema_of_variant(v) == "BIGINT", F.try_variant_get(v, "$", "long")).otherwise(F.try_variant_get(v, "$", EXACT).try_cast("long"))
    return F.try_variant_get(v, "$", kind.simpleString())


def is_missing(name: str) -> Column:
    return ~F.array_contains("present", name)


def is_null(name: str) -> Column:
    """Whether the key is there with null: an SQL NULL in a typed column, the variant null in a VARIANT one."""
    return F.array_contains("present", name) & F.coalesce(F.to_json(F.struct(F.col(name).alias("x"))).isin("{}", '{"x":null}'), F.lit(True))


def get_additional_property(key: str) -> Column:
    return F.try_element_at("extra", F.lit(key))


def encode(schema: Mapping) -> Column:
    """Compact JSON of a decoded row: declared keys that were present (null too) and the extras, key-sorted."""
    own = [F.when(F.array_contains("present", k), F.struct(F.lit(k).alias("key"), F.coalesce(_variant(F.col(k)), F.parse_json(F.lit("null"))).alias("value"))) for k in schema.get("properties", {})]
    entries = F.concat(F.array_compact(F.array(*own)), F.map_entries("extra"))
    return F.to_json(F.to_variant_object(F.map_from_entries(entries)))


def _variant(c: Column) -> Column:
    return F.try_variant_get(F.parse_json(F.to_json(F.struct(c.alias("x")))), "$.x", "variant")


def round_trip_audit(df: DataFrame, json_col: str, schema: Mapping, keep: list[str]) -> DataFrame:
    """keep... and same: whether decode and encode give the input again under JSON equality."""
    good, _ = decode(df.withColumn("_in", F.to_json(F.try_parse_json(json_col))), json_col, schema, [*keep, "_in"])
    plain = lambda c: F.regexp_replace(c, r"(?<=\d)\.0(?=[,}\]])", "")
    return good.select(*keep, (plain(F.col("_in")) == plain(encode(schema))).alias("same"))


def tagged_union(value: Column, tag: str, branches: Mapping[str, T.DataType]) -> Column:
    """Struct with one field per branch, filled for the branch that the tag names; unknown tags leave all null."""
    t = F.try_variant_get(value, f"$['{tag}']", "string")
    return F.struct(*(F.when(t == k, F.try_variant_get(value, "$", kind.simpleString())).alias(k) for k, kind in branches.items()))
