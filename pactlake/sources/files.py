"""Files in and out: golden maps, JSON records, manifests, values and grades. Paths are any that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "struct<manifest_version:int,schemas:map<string,struct<stable_id:string,versions:array<struct<version:int,schema_sha256:string,schema:variant>>>>>"

_HISTORY = "struct<stable_id:string,versions:array<struct<version:int,schema_sha256:string,schema:variant>>>"


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """(id, mode, schema_json, stable_id) of a file that maps ids to {mode, schema, stable_id}."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,struct<mode:string,schema:variant,stable_id:string>>")).alias("id", "e"))
    return rows.select("id", "e.mode", F.to_json("e.schema").alias("schema_json"), F.coalesce("e.stable_id", "id").alias("stable_id"))


def split_json(df: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows with doc VARIANT, rows whose text is no JSON)."""
    parsed = df.withColumn("doc", F.try_parse_json(text_col))
    return parsed.filter("doc IS NOT NULL"), parsed.filter("doc IS NULL").drop("doc")


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return split_json(spark.read.text(path), "value")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(key, manifest_version, stable_id, version, schema_sha256, schema_json, ordinal) of one manifest document, or of
    what write_manifest wrote. An id without versions has one row with neither version nor ordinal."""
    m = spark.read.text(path, wholetext=True).select(F.from_json("value", _MANIFEST).alias("m")).select("m.manifest_version", F.explode("m.schemas").alias("key", "h"))
    lines = spark.read.text(path).select(F.from_json("value", _HISTORY).alias("h")).filter("h.stable_id IS NOT NULL AND h.versions IS NOT NULL")
    rows = m.select("key", "manifest_version", "h.stable_id", F.posexplode_outer("h.versions").alias("ordinal", "v"))
    rows = rows.unionByName(lines.select(F.col("h.stable_id").alias("key"), F.lit(1).alias("manifest_version"), "h.stable_id", F.posexplode_outer("h.versions").alias("ordinal", "v")))
    return rows.select("key", "manifest_version", "stable_id", "v.version", "v.schema_sha256", F.to_json("v.schema").alias("schema_json"), "ordinal")


def write_manifest(history: DataFrame, path: str) -> None:
    """One JSON line per stable_id, versions in order (none for a row without a version), to a path that doesn't exist yet:
    an older manifest stays whole until readers are pointed to the new path. read_manifest reads it back."""
    versions = F.array_sort(F.collect_list(F.when(F.col("version").isNotNull(), F.struct("version", "schema_sha256", F.parse_json("schema_json").alias("schema")))), lambda a, b: a["version"] - b["version"])
    history.groupBy("stable_id").agg(versions.alias("versions")).write.json(path)


def write_values(df: DataFrame, value_col: str, path: str) -> None:
    """One JSON value a line, to a path that doesn't exist yet."""
    df.select(F.col(value_col).alias("value")).write.text(path)


def write_grades(grades: DataFrame, path: str) -> None:
    """One JSON object a line, to a path that doesn't exist yet."""
    grades.write.json(path)
