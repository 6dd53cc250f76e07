"""Validation of record tables by contracts: one narrow stage, no shuffle, no Python on the executors."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlake.functions.predicates import compile_contract, contract_checks
from pactlake.functions.values import column, value_of

_FAILED = "array<struct<keyword:string,pointer:string>>"


def as_record(df: DataFrame, columns: list[str] | None = None, to: str = "record") -> DataFrame:
    """The columns as one struct column beside them."""
    return df.withColumn(to, F.struct(*(columns or df.columns)))


def validate(df: DataFrame, value_col: str, schema, max_depth: int = 4) -> DataFrame:
    """df with valid BOOLEAN and failed ARRAY<STRUCT<keyword, pointer>>; valid is NULL where a value that fails no check
    reaches deeper into a recursive contract than max_depth."""
    checks = contract_checks(schema, value_of(df, value_col), max_depth=max_depth)
    told = [F.when(~column(c), F.struct(F.lit(k).alias("keyword"), F.lit(p).alias("pointer"))) for k, p, c in checks]
    failed = F.array_compact(F.array(*told)) if told else F.array()
    open_ones = [column(c).isNull() for _, _, c in checks if not isinstance(c, bool)]
    undecided = reduce(lambda a, b: a | b, open_ones, F.lit(False))
    return df.withColumn("failed", failed.cast(_FAILED)).withColumn("valid", F.when((F.size("failed") > 0) | ~undecided, F.size("failed") == 0))


def flag_valid(df: DataFrame, value_col: str, schema, to: str = "valid", max_depth: int = 4) -> DataFrame:
    """df with the verdict only, which keeps the expression small."""
    return df.withColumn(to, compile_contract(schema, value_of(df, value_col), max_depth=max_depth))


def split_valid(df: DataFrame, value_col: str, schema) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, quarantined rows); rows that are not decided go to quarantine, with valid NULL."""
    flagged = validate(df, value_col, schema)
    return flagged.filter("valid").drop("valid", "failed"), flagged.filter("valid IS NOT TRUE")


def validity_matrix(df: DataFrame, value_col: str, schemas: Mapping[str, object], keep: list[str]) -> DataFrame:
    """Long form (keep..., version, valid): all versions in one pass over the records."""
    value = value_of(df, value_col)
    flags = [F.struct(F.lit(name).alias("version"), compile_contract(s, value).alias("valid")) for name, s in schemas.items()]
    return df.select(*keep, F.explode(F.array(*flags)).alias("_m")).select(*keep, "_m.version", "_m.valid")


def data_compat(df: DataFrame, value_col: str, source, target, direction: str = "serializer", keep: list[str] | None = None) -> DataFrame:
    """Witnesses: records that the source contract accepts and the target contract does not. In the deserializer
    direction records with keys that the source does not declare are no emitted values and are left out."""
    value = value_of(df, value_col)
    emitted = F.lit(True)
    if direction == "deserializer" and isinstance(source, dict) and source.get("properties"):
        emitted = F.size(F.array_except(value.keys(), F.array(*map(F.lit, source["properties"])))) == 0
    found = df.filter(compile_contract(source, value) & ~compile_contract(target, value) & emitted)
    return found.select(*keep) if keep else found
