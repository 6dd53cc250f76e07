"""Version stamping of contracts and of records, and reading mixed-version tables back."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlake.functions.predicates import compile_contract
from pactlake.functions.values import Variant, col_of, once, value_of

from .compat import check_compat, invalid_contracts, pair_verdict
from .registry_scan import canonical_hash


def latest_version(history: DataFrame) -> DataFrame:
    """(stable_id, version, schema_sha256, schema_json) of the highest version."""
    top = F.max_by(F.struct("version", "schema_sha256", "schema_json"), "version").alias("t")
    return history.filter("version IS NOT NULL").groupBy("stable_id").agg(top).select("stable_id", "t.*")


def manifest_errors(history: DataFrame) -> DataFrame:
    """(stable_id, version, error) for empty ids, ids without versions (a row with no version), versions that don't rise,
    hashes that don't match and contracts that aren't valid; where history has the columns key and manifest_version, also
    for keys other than the id and manifests of another version."""
    texts = history.filter("schema_json IS NOT NULL").select(F.sha2("schema_json", 256).alias("_text"), "schema_json").dropDuplicates(["_text"])
    bad = invalid_contracts(texts, ["_text"]).withColumn("_bad", F.lit(True))
    history = history.withColumn("_text", F.sha2("schema_json", 256)).join(bad, "_text", "left").withColumn("_before", F.lag("version").over(Window.partitionBy("stable_id").orderBy("ordinal")))
    found = F.array(
        F.when(F.coalesce(F.col("stable_id").cast("string"), F.lit("")) == "", F.lit("empty stable_id")),
        F.when(F.col("_before") >= F.col("version"), F.lit("versions must rise")),
        F.when(F.col("version").isNull(), F.lit("no versions")),
        F.when(F.col("schema_sha256") != canonical_hash(F.col("schema_json")), F.lit("hash does not match")),
        F.when(F.col("_bad"), F.lit("contract is not valid")),
    )
    if "key" in history.columns:
        found = F.array_append(found, F.when(~F.col("key").eqNullSafe(F.col("stable_id")), F.lit("key is not the stable_id")))
    if "manifest_version" in history.columns:
        found = F.array_append(found, F.when(~F.col("manifest_version").eqNullSafe(F.lit(1)), F.lit("unknown manifest version")))
    return history.select("stable_id", "version", F.explode(F.array_compact(found)).alias("error"))


def stamp_batch(history: DataFrame, candidates: DataFrame) -> DataFrame:
    """(stable_id, status, version, schema_sha256, schema_json) for candidates (stable_id, schema_json): new,
    unchanged, compatible_update (keeps the version) or breaking_change (takes the next)."""
    now = latest_version(history).select("stable_id", F.col("version").alias("_v"), F.col("schema_sha256").alias("_h"), F.col("schema_json").alias("_s"))
    met = candidates.withColumn("schema_sha256", canonical_hash(F.col("schema_json"))).join(now, "stable_id", "left")
    changed = met.filter(F.col("_v").isNotNull() & (F.col("schema_sha256") != F.col("_h"))).select("stable_id", F.lit("both").alias("role"), F.col("_s").alias("old"), F.col("schema_json").alias("new"))
    judged = met.join(pair_verdict(check_compat(changed, ["stable_id"]), ["stable_id"]), "stable_id", "left")
    status = F.when(F.col("_v").isNull(), "new").when(F.col("schema_sha256") == F.col("_h"), "unchanged").when(F.col("verdict") == "compatible", "compatible_update").otherwise("breaking_change")
    version = F.when(F.col("_v").isNull(), 1).when(status == "breaking_change", F.col("_v") + 1).otherwise(F.col("_v"))
    return judged.select("stable_id", status.alias("status"), version.alias("version"), "schema_sha256", "schema_json")


def next_manifest(history: DataFrame, stamped: DataFrame) -> DataFrame:
    """The history after the batch: a compatible update replaces the latest version in place, others append."""
    kept = history.filter("version IS NOT NULL").join(stamped.select("stable_id", "version"), ["stable_id", "version"], "left_anti")
    cols = ["stable_id", "version", "schema_sha256", "schema_json"]
    return kept.select(*cols).unionByName(stamped.select(*cols))


def writer_schema(version: Column, schema_json: Column) -> Column:
    """JSON text of the envelope that a writer of one version produces, local references moved along; NULL for schemas
    whose references aren't pointers into themselves."""
    v = version.cast("string")
    plain = F.to_json(F.try_parse_json(schema_json))
    moved = F.regexp_replace(F.when(~plain.rlike('"\\$ref":"(?!#["/])'), plain), '"\\$ref":"#', F.concat(F.lit('"\\$ref":"#/\\$defs/v'), v))
    return F.concat(F.lit('{"$defs":{"v'), v, F.lit('":'), moved, F.lit('},"additionalProperties":false,"properties":{"data":{"$ref":"#/$defs/v'), v, F.lit('"},"version":{"const":'), v, F.lit('}},"required":["version","data"],"type":"object"}'))


def reader_schema(history: DataFrame) -> DataFrame:
    """(stable_id, schema_json): one of the versions' envelopes, newest first."""
    versions = F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("version", "schema_json")))), lambda x: writer_schema(x["version"], x["schema_json"]))
    return history.groupBy("stable_id").agg(F.concat(F.lit('{"oneOf":['), F.array_join(versions, ","), F.lit("]}")).alias("schema_json"))


def stamp_records(df: DataFrame, data_col: str, version: int, schema, to: str = "envelope") -> DataFrame:
    """Valid records only, wrapped as JSON {version, data}."""
    good = df.filter(compile_contract(schema, value_of(df, data_col)))
    return good.withColumn(to, F.to_json(F.struct(F.lit(version).alias("version"), F.col(data_col).alias("data"))))


def read_stamped(df: DataFrame, envelope_col: str, versions: Mapping[int, object]) -> DataFrame:
    """df with version, data VARIANT and valid: dispatched by version; unknown versions and extra keys are not valid."""
    opened = once(df, "_e", F.try_parse_json(envelope_col)).withColumn("version", F.try_variant_get("_e", "$.version", "int"))
    opened = once(opened, "data", F.try_variant_get("_e", "$.data", "variant"))
    closed = F.size(F.array_except(Variant(F.col("_e")).keys(), F.array(F.lit("version"), F.lit("data")))) == 0
    fits = F.lit(False)
    for n, s in versions.items():
        fits = F.when(F.col("version") == n, compile_contract(s, Variant(F.col("data")))).otherwise(fits)
    return opened.withColumn("valid", col_of(closed) & col_of(fits) & F.col("data").isNotNull()).drop("_e")


def version_mix(read: DataFrame, *keys: str) -> DataFrame:
    return read.groupBy(*keys, "version", "valid").agg(F.count("*").alias("n"))
