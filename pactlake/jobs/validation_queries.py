"""Queries over the driver tables for the validation operators, each with SQL that counts the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlake.functions.values import once
from pactlake.operators.validation import as_record, data_compat, flag_valid, split_valid, validate, validity_matrix

EVENT = {
    "type": "object",
    "required": ["event_id", "user_id", "event_type", "value"],
    "properties": {
        "event_type": {"enum": ["click", "view", "purchase", "signup", "error"]},
        "user_id": {"type": "integer", "minimum": 0},
        "value": {"type": "number", "exclusiveMinimum": 0, "maximum": 400},
        "props": {"type": "string", "pattern": '^\\{"k": [0-9]{1,2}\\}$'},
    },
}
EVENT_SQL = "event_id IS NOT NULL AND user_id >= 0 AND event_type IN ('click','view','purchase','signup','error') AND value > 0 AND value <= 400 AND coalesce(regexp_matches(props, '^\\{\"k\": [0-9]{1,2}\\}$'), true)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as (event_id, event_type, doc VARIANT): free-form records with a nested object."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value", "props")
    doc = F.to_json(F.struct("event_type", "user_id", "value", F.parse_json("props").alias("props")))
    return once(e.select("event_id", "event_type", doc.alias("_text")), "doc", F.parse_json("_text")).drop("_text")


def chat_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, roles ARRAY<STRING>) in turn order; a conversation is bounded by its own turns."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return turns.select("conv_id", F.transform("t", lambda x: x["role"]).alias("roles"))


def tally(df: DataFrame, group: str, row: str) -> DataFrame:
    return df.groupBy(F.col(group).cast("string").alias("grp"), "valid").agg(F.count("*").alias("n"), F.sum(row).alias("ids"))


def _tally_sql(source: str, group: str, row: str, test: str) -> str:
    return f"SELECT CAST({group} AS VARCHAR) AS grp, coalesce(({test}), false) AS valid, count(*) AS n, CAST(sum({row}) AS BIGINT) AS ids FROM {source} GROUP BY 1, 2"


_CHATS = "(SELECT conv_id, list(role ORDER BY turn, role) AS roles FROM conversations GROUP BY conv_id)"
_K = "CAST(json_extract(props, '$.k') AS BIGINT)"
#: id -> (source, group, row id, contract, SQL predicate). Sources: a table's typed rows, or documents as VARIANT.
CASES: dict[str, tuple[str, str, str, object, str]] = {
    "V1_boolean_schema": ("customer", "c_mktsegment", "c_custkey", {"properties": {"c_acctbal": True, "c_missing": False}}, "true"),
    "V2_type": ("events.doc", "event_type", "event_id", {"properties": {"value": {"type": ["string", "integer"]}}}, "value = floor(value)"),
    "V3_integer_by_value": ("lineitem", "l_returnflag", "l_orderkey", {"properties": {"l_quantity": {"type": "integer"}, "l_extendedprice": {"type": "integer"}}}, "l_quantity = floor(l_quantity) AND l_extendedprice = floor(l_extendedprice)"),
    "V4_enum": ("orders", "o_orderstatus", "o_orderkey", {"properties": {"o_orderpriority": {"enum": ["1-URGENT", "2-HIGH", 3]}}}, "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "V5_const": ("events.doc", "event_type", "event_id", {"properties": {"event_type": {"const": "click"}}}, "event_type = 'click'"),
    "V6_length": ("documents", "lang", "doc_id", {"properties": {"text": {"minLength": 100, "maxLength": 2000}}}, "length(text) BETWEEN 100 AND 2000"),
    "V7_pattern": ("customer", "c_mktsegment", "c_custkey", {"properties": {"c_name": {"pattern": "#0+[0-9]*[05]$"}}}, "regexp_matches(c_name, '#0+[0-9]*[05]$')"),
    "V8_bounds": ("lineitem", "l_returnflag", "l_orderkey", {"properties": {"l_quantity": {"minimum": 5, "maximum": 40}}}, "l_quantity BETWEEN 5 AND 40"),
    "V9_exclusive_bounds": ("orders", "o_orderstatus", "o_orderkey", {"properties": {"o_totalprice": {"exclusiveMinimum": 1000, "exclusiveMaximum": 200000}}}, "o_totalprice > 1000 AND o_totalprice < 200000"),
    "V10_multiple_of": ("lineitem", "l_returnflag", "l_orderkey", {"properties": {"l_quantity": {"multipleOf": 3}, "l_discount": {"multipleOf": 0.02}}}, "l_quantity % 3 = 0 AND abs(l_discount / 0.02::DOUBLE - round(l_discount / 0.02::DOUBLE)) <= 4 * pow(2, -52) * greatest(abs(l_discount / 0.02::DOUBLE), 1)"),
    "V11_required": ("events.doc", "event_type", "event_id", {"required": ["user_id", "props"], "properties": {"props": {"required": ["k"]}}}, "user_id IS NOT NULL AND props IS NOT NULL AND json_extract(props, '$.k') IS NOT NULL"),
    "V12_dependent_required": ("events.doc", "event_type", "event_id", {"dependentRequired": {"value": ["session"]}}, "value IS NULL"),
    "V13_properties": ("events.doc", "event_type", "event_id", {"properties": {"props": {"properties": {"k": {"maximum": 49}}}}}, f"{_K} <= 49"),
    "V14_pattern_properties": ("events.doc", "event_type", "event_id", {"patternProperties": {"^value$": {"maximum": 200}, "_id$": {"multipleOf": 2}}}, "value <= 200 AND user_id % 2 = 0"),
    "V15_additional_properties": ("events.doc", "event_type", "event_id", {"properties": {"event_type": True, "props": True}, "patternProperties": {"^user": True}, "additionalProperties": {"minimum": 50}}, "value >= 50"),
    "V16_property_names": ("events.doc", "event_type", "event_id", {"propertyNames": {"maxLength": 10}, "properties": {"props": {"propertyNames": {"const": "k"}}}}, "true"),
    "V17_property_counts": ("events.doc", "event_type", "event_id", {"minProperties": 4, "properties": {"props": {"maxProperties": 1}}}, "true"),
    "V18_dependent_schemas": ("events.doc", "event_type", "event_id", {"dependentSchemas": {"props": {"properties": {"value": {"minimum": 100}}}}}, "value >= 100"),
    "V19_items": ("embeddings", "label", "vec_id", {"properties": {"embedding": {"items": {"minimum": -0.3, "maximum": 0.3}}}}, "len(list_filter(embedding, lambda x: x < -0.3 OR x > 0.3)) = 0"),
    "V20_prefix_items": ("chats", "conv_id % 7", "conv_id", {"properties": {"roles": {"prefixItems": [{"enum": ["system", "user"]}, {"const": "assistant"}]}}}, "roles[1] IN ('system', 'user') AND (len(roles) < 2 OR roles[2] = 'assistant')"),
    "V21_item_counts": ("chats", "conv_id % 7", "conv_id", {"properties": {"roles": {"minItems": 3, "maxItems": 6}}}, "len(roles) BETWEEN 3 AND 6"),
    "V22_unique_items": ("chats", "conv_id % 7", "conv_id", {"properties": {"roles": {"uniqueItems": True}}}, "len(list_distinct(roles)) = len(roles)"),
    "V23_contains": ("chats", "conv_id % 7", "conv_id", {"properties": {"roles": {"contains": {"const": "user"}, "minContains": 2, "maxContains": 3}}}, "len(list_filter(roles, lambda r: r = 'user')) BETWEEN 2 AND 3"),
    "V24_all_of": ("lineitem", "l_returnflag", "l_orderkey", {"allOf": [{"properties": {"l_tax": {"minimum": 0.02}}}, {"properties": {"l_discount": {"maximum": 0.06}}}]}, "l_tax >= 0.02 AND l_discount <= 0.06"),
    "V25_any_of": ("customer", "c_mktsegment", "c_custkey", {"anyOf": [{"properties": {"c_acctbal": {"minimum": 5000}}}, {"properties": {"c_nationkey": {"maximum": 5}}}]}, "c_acctbal >= 5000 OR c_nationkey <= 5"),
    "V26_one_of": ("customer", "c_mktsegment", "c_custkey", {"oneOf": [{"properties": {"c_acctbal": {"minimum": 5000}}}, {"properties": {"c_nationkey": {"maximum": 5}}}]}, "(c_acctbal >= 5000) <> (c_nationkey <= 5)"),
    "V27_not": ("customer", "c_mktsegment", "c_custkey", {"not": {"properties": {"c_mktsegment": {"const": "BUILDING"}}}}, "c_mktsegment <> 'BUILDING'"),
    "V28_if_then_else": ("lineitem", "l_returnflag", "l_orderkey", {"if": {"properties": {"l_returnflag": {"const": "R"}}}, "then": {"properties": {"l_quantity": {"maximum": 25}}}, "else": {"properties": {"l_tax": {"minimum": 0.04}}}}, "CASE WHEN l_returnflag = 'R' THEN l_quantity <= 25 ELSE l_tax >= 0.04 END"),
    "V29_local_ref": ("events.doc", "event_type", "event_id", {"$defs": {"small/one": {"maximum": 60}}, "properties": {"value": {"$ref": "#/$defs/small~1one", "minimum": 10}, "props": {"additionalProperties": {"$ref": "#/$defs/small~1one"}}}}, f"value BETWEEN 10 AND 60 AND {_K} <= 60"),
    "V30_unevaluated": ("events.doc", "event_type", "event_id", {"properties": {"event_type": True, "user_id": True}, "anyOf": [{"properties": {"value": {"minimum": 100}}}, {"properties": {"props": {"properties": {"k": {"minimum": 50}}}}}], "unevaluatedProperties": {"type": "object"}}, "value >= 100"),
}
_ROWS = {"events.doc": "events", "chats": _CHATS}


def _case(source: str, group: str, row: str, contract: object) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if source == "events.doc":
            df = flag_valid(event_documents(spark, sf_dir), "doc", contract)
        else:
            rows = chat_documents(spark, sf_dir) if source == "chats" else table(spark, sf_dir, source)
            df = flag_valid(as_record(rows), "record", contract)
        return tally(df.withColumn("_group", F.expr(group)), "_group", row)

    return run


def minimum_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = as_record(table(spark, sf_dir, "events"))
    return flag_valid(events, "record", EVENT).groupBy("event_type", "valid").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))


def failed_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which checks fail how often, by pointer."""
    rows = validate(as_record(table(spark, sf_dir, "lineitem")), "record", LINE)
    return rows.select(F.explode("failed").alias("f")).groupBy("f.keyword", "f.pointer").agg(F.count("*").alias("n"))


LINE = {"properties": {"l_quantity": {"maximum": 40}, "l_tax": {"minimum": 0.02}, "l_returnflag": {"enum": ["R", "N"]}}}


def v31_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = split_valid(as_record(table(spark, sf_dir, "lineitem")), "record", LINE)
    side = lambda df, name: df.agg(F.lit(name).alias("side"), F.count("*").alias("n"), F.sum("l_orderkey").alias("ids"))
    return side(good, "accepted").unionByName(side(bad, "quarantined"))


VERSIONS = {"v1": {"properties": {"props": {"properties": {"k": {"maximum": 99}}}}}, "v2": {"properties": {"props": {"properties": {"k": {"maximum": 49}}}}}, "v3": {"properties": {"props": {"properties": {"k": {"maximum": 49, "multipleOf": 7}}}, "value": {"minimum": 20}}}}


def v32_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity_matrix(event_documents(spark, sf_dir), "doc", VERSIONS, ["event_id", "event_type"]).groupBy("version", "event_type", "valid").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def r37_data_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Witnesses against reading v1 data with v2, by event type; and against v2 with v1, of which there are none."""
    docs = event_documents(spark, sf_dir)
    one = data_compat(docs, "doc", VERSIONS["v1"], VERSIONS["v2"], keep=["event_id", "event_type"]).withColumn("pair", F.lit("v1-v2"))
    two = data_compat(docs, "doc", VERSIONS["v2"], VERSIONS["v1"], keep=["event_id", "event_type"]).withColumn("pair", F.lit("v2-v1"))
    return one.unionByName(two).groupBy("pair", "event_type").agg(F.count("*").alias("witnesses"), F.min("event_id").alias("first_witness"))


QUERIES = {"minimum_slice": minimum_slice, **{k: _case(*c[:4]) for k, c in CASES.items()}, "V31_split_valid": v31_split, "V32_validity_matrix": v32_matrix, "R37_data_compat": r37_data_compat, "V_failed_keywords": failed_keywords}
_V3 = f"({_K} <= 49 AND {_K} % 7 = 0 AND value >= 20)"
ORACLE_SQL = {
    "minimum_slice": f"SELECT event_type, coalesce(({EVENT_SQL}), false) AS valid, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users FROM events GROUP BY 1, 2",
    **{k: _tally_sql(_ROWS.get(s, s), g, r, test) for k, (s, g, r, _, test) in CASES.items()},
    "V31_split_valid": "SELECT CASE WHEN l_quantity <= 40 AND l_tax >= 0.02 AND l_returnflag IN ('R', 'N') THEN 'accepted' ELSE 'quarantined' END AS side, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS ids FROM lineitem GROUP BY 1",
    "V32_validity_matrix": f"SELECT version, event_type, valid, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM (SELECT event_id, event_type, unnest(['v1', 'v2', 'v3']) AS version, unnest([{_K} <= 99, {_K} <= 49, {_V3}]) AS valid FROM events) GROUP BY ALL",
    "R37_data_compat": f"SELECT 'v1-v2' AS pair, event_type, count(*) AS witnesses, min(event_id) AS first_witness FROM events WHERE {_K} <= 99 AND NOT {_K} <= 49 GROUP BY 2",
    "V_failed_keywords": "SELECT keyword, pointer, count(*) AS n FROM (SELECT 'maximum' AS keyword, '#/properties/l_quantity/maximum' AS pointer FROM lineitem WHERE l_quantity > 40 UNION ALL SELECT 'minimum', '#/properties/l_tax/minimum' FROM lineitem WHERE l_tax < 0.02 UNION ALL SELECT 'enum', '#/properties/l_returnflag/enum' FROM lineitem WHERE l_returnflag NOT IN ('R', 'N')) GROUP BY ALL",
}
