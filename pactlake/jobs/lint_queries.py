"""Queries for the registry checks, manifests, envelopes, parameter overrides and generated values, with their SQL.

The registry here has one contract for each user of events; what is wrong with it follows from the user's number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlake.functions.predicates import compile_contract
from pactlake.functions.values import Variant
from pactlake.operators import compat, generate, openapi, registry_generation, registry_scan, stamping

from .codec_queries import _IDS, api_documents
from .codec_queries import ORACLE_SQL as CODEC_SQL
from .registry_queries import _ID, _REG, observed_registry
from .validation_queries import table

_ONE = ["stable_id"]


def user_registry(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """(stable_id, schema_json): per user of events; shift moves the faults to other users."""
    users = table(spark, sf_dir, "events").filter("user_id IS NOT NULL").select(F.col("user_id").alias("stable_id")).distinct()
    k = F.col("stable_id") + shift
    pick = lambda n, *texts: F.element_at(F.array(*map(F.lit, texts)), (k % n + 1).cast("int"))
    ok = registry_scan.DIALECTS[0]
    dialect = pick(5, "http://json-schema.org/draft-07/schema#", ok + "#", ok, ok, registry_scan.DIALECTS[1])
    ref = pick(3, "#/$defs/a~1b", "#/$defs/gone", "other.json")
    text = F.when(k % 7 == 0, '"contentEncoding":"base64",').when(k % 7 == 1, '"$anchor":"x",').otherwise("")
    low = F.when(k % 6 == 0, '"minimum":1,').otherwise("")
    body = F.format_string(
        '{"$defs":{"a/b":{"type":"integer"}},"$schema":"%s","properties":{"big":{"maximum":%d,"type":"%s"},"kind":{%s},"ref":{"$ref":"%s"},"step":{"multipleOf":%s,"type":"number"},"text":{%s%s"type":"string"}},"required":["text","ref","text"],"type":"object"}',
        dialect, k % 4 + registry_scan.SAFE, pick(2, "integer", "number"), pick(2, '"enum":["b","a","b"]', '"const":"a"'), ref, pick(2, "2", "0.5"), text, low,
    )
    return users.select("stable_id", body.alias("schema_json"))


def _nodes(spark, sf_dir, shift=0):
    return registry_scan.schema_nodes(user_registry(spark, sf_dir, shift), _ONE)


def _constraints(spark, sf_dir):
    return registry_scan.constraints(_nodes(spark, sf_dir), _ONE)


def n3_pointers(spark, sf_dir):
    return _nodes(spark, sf_dir).filter(F.contains("pointer", F.lit("~"))).groupBy("pointer").agg(F.count("*").alias("n"))


def n4_warnings(spark, sf_dir):
    return registry_scan.keyword_findings(_nodes(spark, sf_dir), _ONE, registry_scan.WARNED)


def n5_hard_errors(spark, sf_dir):
    """The first pointer with a keyword that no contract may have."""
    found = registry_scan.keyword_findings(_nodes(spark, sf_dir), _ONE, registry_scan.HARD)
    return found.groupBy("stable_id").agg(F.min(F.struct("pointer", "keyword")).alias("f")).select("stable_id", "f.pointer", "f.keyword")


def n6_unsafe_bounds(spark, sf_dir):
    return registry_scan.unsafe_bounds(_constraints(spark, sf_dir), _ONE).select("stable_id", "pointer", "keyword", F.col("value").cast("long").alias("value"))


def n7_fractional_steps(spark, sf_dir):
    return registry_scan.fractional_multiple_of(_constraints(spark, sf_dir)).select("stable_id", "pointer", F.col("value").cast("double").alias("value"))


def n8_unresolved_refs(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return registry_scan.unresolved_refs(registry_scan.constraints(nodes, _ONE), nodes, _ONE)


def n9_dialects(spark, sf_dir):
    return registry_scan.dialect_findings(_constraints(spark, sf_dir)).select("stable_id", F.trim("value", F.lit('"')).alias("dialect"))


def n10_normalised(spark, sf_dir):
    """Enums with constants among them and required names, sorted and without repeats."""
    n = registry_scan.node_table(_nodes(spark, sf_dir), _ONE)
    values = F.coalesce(F.array_join("n.enum", ","), F.lit(""))
    return n.filter("pointer IN ('#', '#/properties/kind')").select("stable_id", "pointer", values.alias("enum_values"), F.array_join("n.required", ",").alias("required_names"))


def n12_irrelevant(spark, sf_dir):
    return registry_scan.irrelevant_keywords(_constraints(spark, sf_dir), _ONE)


def n16_unions(spark, sf_dir):
    """Per user a contract with a list of types, a oneOf of disjoint types for even numbers, of overlapping ones for odd."""
    users = user_registry(spark, sf_dir).select("stable_id")
    other = F.when(F.col("stable_id") % 2 == 0, "string").otherwise("number")
    reg = users.select("stable_id", F.format_string('{"properties":{"a":{"type":["string","null"]},"b":{"oneOf":[{"type":"integer"},{"type":"%s"}]}}}', other).alias("schema_json"))
    return compat.union_forms(reg, _ONE).select("stable_id", "pointer", "form", F.array_join("branches", ",").alias("branches"))


def c3_grade_warnings(spark, sf_dir):
    sides = [_nodes(spark, sf_dir, shift) for shift in (0, 1)]
    return registry_scan.grade_warnings(*sides, _ONE).select("stable_id", F.array_join("warnings", ";").alias("warnings"))


def t1_manifest_errors(spark, sf_dir):
    """Every tenth id has hashes that don't match, every ninth has versions that don't rise."""
    reg = observed_registry(spark, sf_dir).withColumn("ordinal", F.col("version")).withColumn("version", F.when(F.col("stable_id") % 9 == 0, F.lit(1)).otherwise(F.col("version")))
    right = registry_scan.canonical_hash(F.col("schema_json"))
    return stamping.manifest_errors(reg.withColumn("schema_sha256", F.when(F.col("stable_id") % 10 == 0, F.lit("sha256:0")).otherwise(right))).groupBy("stable_id", "error").agg(F.count("*").alias("n"))


def t5_writer_schema(spark, sf_dir):
    return observed_registry(spark, sf_dir).select(*_ID, stamping.writer_schema(F.col("version"), F.col("schema_json")).alias("envelope"))


def t6_reader_schema(spark, sf_dir):
    return stamping.reader_schema(observed_registry(spark, sf_dir)).select("stable_id", F.col("schema_json").alias("envelope"))


def t7_rewritten_refs(spark, sf_dir):
    """Where the references inside an envelope point."""
    made = user_registry(spark, sf_dir).select("stable_id", stamping.writer_schema(F.lit(3), F.col("schema_json")).alias("envelope"))
    return made.select("stable_id", F.get_json_object("envelope", "$['$defs']['v3']['properties']['ref']['$ref']").alias("inner_ref"), F.get_json_object("envelope", "$['properties']['data']['$ref']").alias("outer_ref"))


def o3_overrides(spark, sf_dir):
    """A header parameter of the whole path, required, beside each operation's own of that name: the own one counts."""
    own = '{"in":"path","name":"id","required":true}'
    docs = api_documents(spark, sf_dir).withColumn("doc_json", F.replace("doc_json", F.lit(own), F.lit(own + ',{"in":"header","name":"x-trace","required":true}')))
    params = openapi.parameters(openapi.operations(docs, _IDS), _IDS)
    return params.groupBy("side", "method", "location", "name", "required").agg(F.count("*").alias("n"))


def rich_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, doc_json): one API description for each page with a url; its surfaces follow from the page's number."""
    k = F.col("page_id")
    body = F.when(k % 3 == 0, '"application/json":{},"Application/JSON ":{},"text/plain":{}').otherwise('"application/json":{},"application/xml":{}')
    headers = F.when(k % 4 == 0, '"X-Id":{},"x-id":{},"Content-Type":{}').otherwise('"X-Id":{},"Link":{}')
    calls, hooks, ref = F.when(k % 5 == 0, ',"callbacks":{"done":{}}').otherwise(""), F.when(k % 6 == 0, ',"webhooks":{"sent":{}}').otherwise(""), F.when(k % 7 == 0, ',"/b":{"$ref":"other.json"}').otherwise("")
    text = F.format_string('{"openapi":"3.1.0","paths":{"/a":{"post":{"requestBody":{"content":{%s}},"responses":{"200":{"headers":{%s}}}%s}}%s}%s}', body, headers, calls, ref, hooks)
    return table(spark, sf_dir, "pages").filter(F.contains("url", F.lit("://"))).select("page_id", text.alias("doc_json"))


def o11_duplicate_media(spark, sf_dir):
    return openapi.duplicate_media(openapi.operations(rich_descriptions(spark, sf_dir), ["page_id"]), ["page_id"])


def o12_response_headers(spark, sf_dir):
    return openapi.response_headers(openapi.operations(rich_descriptions(spark, sf_dir), ["page_id"]), ["page_id"])


def o13_unsupported(spark, sf_dir):
    return openapi.unsupported_surfaces(rich_descriptions(spark, sf_dir), ["page_id"])


#: id -> old contract, new contract (of the numbers a and b), in SQL when new is within old, and old within new, and the
#: verdicts where they are not (incompatible if not given; unknown where the rule proves only one side).
RULES: dict[str, tuple[str, ...]] = {
    "R4_boolean": ('{"type":"object","properties":{"p%s":false}}', '{"type":"object","properties":{"p%s":true}}', "false", "true"),
    "R5_types": ('{"type":["string","integer"],"minLength":%s}', '{"type":["string","number"],"minLength":%s}', "false", "a >= b"),
    "R6_number_bounds": ('{"type":"number","exclusiveMinimum":%s}', '{"type":"number","minimum":%s}', "b > a", "a >= b"),
    "R7_integer_bounds": ('{"type":"integer","minimum":%s}', '{"type":"integer","exclusiveMinimum":%s}', "b + 1 >= a", "a >= b + 1"),
    "R8_integer_number": ('{"type":"integer","maximum":%s}', '{"type":"number","maximum":%s}', "false", "a <= b"),
    "R9_multiple_of": ('{"type":"integer","multipleOf":1%s}', '{"type":"integer","multipleOf":1%s0}', "(100 + 10 * b) % (10 + a) = 0", "false"),
    "R10_length": ('{"type":"string","maxLength":%s}', '{"type":"string","maxLength":%s}', "b <= a", "a <= b"),
    "R11_pattern": ('{"type":"string","pattern":"^%s"}', '{"type":"string","pattern":"^%s"}', "a = b", "a = b"),
    "R12_enum": ('{"enum":[3,%s]}', '{"enum":[3,"x",%s]}', "false", "a = 3 OR a = b"),
    "R13_enum_in_type": ('{"type":"integer","minimum":%s}', '{"enum":[4,%s,9]}', "a <= 4 AND a <= b", "false"),
    "R14_required": ('{"type":"object","required":["k%s","id"]}', '{"type":"object","required":["id","k%s"]}', "a = b", "a = b"),
    "R15_property_counts": ('{"type":"object","maxProperties":%s}', '{"type":"object","maxProperties":%s}', "b <= a", "a <= b"),
    "R16_declared_on_both": ('{"type":"object","properties":{"p":{"type":"number","minimum":%s}}}', '{"type":"object","properties":{"p":{"type":"number","minimum":%s}}}', "b >= a", "a >= b"),
    "R17_only_in_sub": ('{"type":"object","properties":{"k%s":{"type":"null"}},"additionalProperties":false}', '{"type":"object","properties":{"k%s":{"type":"null"}},"additionalProperties":false}', "a = b", "a = b"),
    "R18_only_in_sup": ('{"type":"object","properties":{"k%s":{"type":"string"}}}', '{"type":"object","properties":{"k%s":{"type":"string"}}}', "a = b", "true"),
    "R19_additional": ('{"type":"object","additionalProperties":{"type":"integer","minimum":%s}}', '{"type":"object","additionalProperties":{"type":"integer","minimum":%s}}', "b >= a", "true"),
    "R20_patterns": ('{"type":"object","patternProperties":{"^x":{"type":"integer","minimum":%s}}}', '{"type":"object","patternProperties":{"^x":{"type":"integer","minimum":%s}}}', "b >= a", "a >= b"),
    "R20_same_patterns": ('{"type":"object","patternProperties":{"^x":{"type":"null"}},"minProperties":%s}', '{"type":"object","patternProperties":{"^x":{"type":"null"}},"minProperties":%s}', "b >= a", "a >= b"),
    "R21_property_names": ('{"type":"object","propertyNames":{"enum":["id","k%s"]}}', '{"type":"object","propertyNames":{"enum":["k%s","id"]}}', "a = b", "a = b", "incompatible", "unknown"),
    "R21_same_names": ('{"type":"object","propertyNames":{"maxLength":5},"maxProperties":%s}', '{"type":"object","propertyNames":{"maxLength":5},"maxProperties":%s}', "b <= a", "a <= b"),
    "R22_dependent_required": ('{"type":"object","dependentRequired":{"a":["k%s"]}}', '{"type":"object","dependentRequired":{"a":["m"],"m":["k%s"]}}', "a = b", "false"),
    "R23_item_counts": ('{"type":"array","minItems":%s}', '{"type":"array","minItems":%s}', "b >= a", "a >= b"),
    "R24_unique_items": ('{"type":"array","uniqueItems":true,"maxItems":%s}', '{"type":"array","maxItems":%s}', "b <= a AND b <= 1", "a <= b"),
    "R25_items": ('{"type":"array","items":{"type":"integer","maximum":%s}}', '{"type":"array","items":{"type":"integer","maximum":%s}}', "b <= a", "a <= b"),
    "R25_prefix_items": ('{"type":"array","prefixItems":[{"type":"integer","maximum":%s}],"items":{"type":"null"}}', '{"type":"array","prefixItems":[{"type":"integer","maximum":%s}],"items":{"type":"null"}}', "b <= a", "a <= b"),
    "R26_contained": ('{"type":"array","contains":{"type":"integer","minimum":%s}}', '{"type":"array","contains":{"type":"integer","minimum":%s},"minContains":2}', "b >= a", "false", "unknown", "incompatible"),
    "R27_union_within": ('{"anyOf":[{"type":"integer","minimum":%s},{"type":"string"}]}', '{"anyOf":[{"type":"string","maxLength":9},{"type":"integer","minimum":%s}]}', "b >= a", "false"),
    "R28_within_union": ('{"anyOf":[{"type":"integer","minimum":%s},{"type":"null"}]}', '{"type":"integer","minimum":%s}', "b >= a", "false"),
    "R29_all_of": ('{"allOf":[{"type":"integer"},{"minimum":%s},{"maximum":50}]}', '{"type":"integer","minimum":%s,"maximum":50}', "b >= a", "a >= b"),
    "R30_one_of": ('{"oneOf":[{"type":"integer","minimum":%s},{"type":"string"}]}', '{"type":"integer","minimum":%s}', "b >= a", "false"),
    "R30_one_of_kept": ('{"oneOf":[{"type":"integer","minimum":%s},{"type":"number","maximum":9}]}', '{"oneOf":[{"type":"integer","minimum":%s},{"type":"number","maximum":9}]}', "a = b", "a = b", "unknown", "unknown"),
    "R31_not": ('{"not":{"enum":[%s,9]}}', '{"enum":[%s,3]}', "NOT (a = b OR a = 3)", "false"),
    "R31_not_not": ('{"not":{"type":"integer","minimum":%s}}', '{"not":{"type":"integer","minimum":%s}}', "b <= a", "a <= b", "unknown", "unknown"),
    "R32_conditional": ('{"if":{"type":"string"},"then":{"maxLength":%s},"else":{"type":"integer"}}', '{"if":{"type":"string"},"then":{"maxLength":%s},"else":{"type":"integer"}}', "b <= a", "a <= b", "unknown", "unknown"),
    "R_references": ('{"$defs":{"n":{"type":"object","properties":{"v":{"type":"integer","minimum":%s},"next":{"$ref":"#/$defs/n"}}}},"$ref":"#/$defs/n"}', '{"$defs":{"m":{"minimum":%s,"type":"integer"},"n":{"type":"object","properties":{"next":{"$ref":"#/$defs/n"},"v":{"$ref":"#/$defs/m"}}}},"$ref":"#/$defs/n"}', "b >= a", "a >= b"),
    "R26_contains": ('{"type":"array","contains":{"type":"null"},"minContains":%s}', '{"type":"array","contains":{"type":"null"},"minContains":%s}', "b >= a", "a >= b"),
    "R8_few_integers": ('{"type":"integer","minimum":0,"maximum":%s}', '{"enum":[0,1,2,%s]}', "b <= a AND a >= 2", "a <= 2 OR (a = 3 AND b = 3)"),
    "R24_few_items": ('{"type":"array","items":{"type":"integer","minimum":1,"maximum":%s},"uniqueItems":true}', '{"type":"array","items":{"type":"integer"},"maxItems":%s}', "false", "a <= b"),
    "R28_cover": ('{"anyOf":[{"type":"integer","minimum":3,"maximum":9},{"type":"integer","minimum":0,"maximum":%s}]}', '{"type":"integer","minimum":0,"maximum":%s}', "a >= 2 OR b <= a", "false"),
    "R28_cover_of_numbers": ('{"anyOf":[{"type":"number","minimum":3},{"type":"number","exclusiveMaximum":%s}]}', '{"type":"number","minimum":%s}', "a >= 3 OR b >= 3", "false"),
    "R33_empty": ('{"type":"integer","minimum":%s,"maximum":3}', '{"type":"integer","minimum":9,"maximum":%s}', "true", "a > 3"),
}


def rule_pairs(spark: SparkSession, sf_dir: str, old: str, new: str) -> DataFrame:
    """(stable_id, role, old, new): per user, contracts with a and b events (by their numbers' parity, modulo 7)."""
    odd = F.coalesce(F.sum(F.col("event_id") % 2), F.lit(0))
    n = table(spark, sf_dir, "events").filter("user_id IS NOT NULL").groupBy(F.col("user_id").alias("stable_id")).agg(((F.count("event_id") - odd) % 7).alias("a"), (odd % 7).alias("b"))
    text = lambda t, c: F.replace(F.lit(t), F.lit("%s"), F.col(c).cast("string"))
    return n.select("stable_id", F.lit("both").alias("role"), text(old, "a").alias("old"), text(new, "b").alias("new"))


def _rule(old: str, new: str) -> Callable[[SparkSession, str], DataFrame]:
    """The pairs of a rule are compared both ways."""
    return lambda spark, sf_dir: compat.check_compat(rule_pairs(spark, sf_dir, old, new), _ONE).select("stable_id", "direction", "verdict")


#: Rules that leave a side unknown, which a witness decides.
REFUTED = ("R31_not_not", "R32_conditional")


def r37_refuted(spark, sf_dir):
    """The pairs of these rules once more, the unknown ones searched for a witness."""
    each = [rule_pairs(spark, sf_dir, *RULES[k][:2]).withColumn("rule", F.lit(k)) for k in REFUTED]
    pairs = each[0].unionByName(each[1])
    return registry_generation.refute_unknown(compat.check_compat(pairs, ["rule", "stable_id"]), pairs, ["rule", "stable_id"]).select("rule", "stable_id", "direction", "verdict")


#: id -> contract that generated values must meet.
GENERATED = {
    "G1_pick": {"properties": {"a": {"enum": ["x", 2, None]}, "b": {"const": {"k": 1}}, "c": {"type": "boolean"}, "d": {"type": "null"}}, "required": ["a", "b", "c", "d"], "type": "object"},
    "G2_integer": {"properties": {"a": {"type": "integer", "minimum": -7, "maximum": 90, "multipleOf": 5}, "b": {"type": "integer", "minimum": 4}}, "required": ["a", "b"], "type": "object"},
    "G3_number": {"type": "number", "minimum": 0.25, "maximum": 9.5},
    "G4_string": {"type": "string", "minLength": 3, "maxLength": 40, "pattern": "^[0-9a-z]*$"},
    "G6_date": {"type": "string", "format": "date", "pattern": "^[12][0-9]{3}-[01][0-9]-[0-3][0-9]$"},
    "G6_uuid": {"type": "string", "format": "uuid", "pattern": "^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"},
    "G7_object": {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "string"}, "c": {"type": "boolean"}}, "required": ["a"], "minProperties": 1, "maxProperties": 3, "additionalProperties": False},
    "G8_array": {"type": "array", "prefixItems": [{"const": "head"}], "items": {"type": "integer", "minimum": 0, "maximum": 9}, "minItems": 1, "maxItems": 5},
    "G9_union": {"anyOf": [{"type": "integer", "minimum": 10, "maximum": 20}, {"type": "string", "minLength": 2}]},
}


def _generated(contract: object) -> Callable[[SparkSession, str], DataFrame]:
    """For each customer a value made from its key; how many of them the contract accepts."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = table(spark, sf_dir, "customer").select("c_mktsegment", generate.value_json(contract, 42, [F.col("c_custkey")]).alias("value"))
        fits = compile_contract(contract, Variant(F.try_parse_json("value")))
        return made.withColumn("fits", fits).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_if("fits").alias("accepted"))

    return run


def g9_rejection(spark, sf_dir):
    """A value for each customer by attempts: even numbers of two branches, of which a third is thrown away."""
    made = generate.generate_for(table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], REJECTED)
    value = F.col("value").cast("long")
    return made.groupBy("status").agg(F.count("*").alias("n"), F.count_if((value % 2 == 0) & value.between(0, 20) & (value % 3 != 0)).alias("right"), F.bool_or((F.col("tried") > 1) & F.col("value").isNotNull()).alias("some_again"))


REJECTED = {"anyOf": [{"type": "integer", "minimum": 0, "maximum": 10, "multipleOf": 2}, {"type": "integer", "minimum": 11, "maximum": 20}], "not": {"multipleOf": 3}, "multipleOf": 2}

QUERIES = {
    "N3_pointers": n3_pointers, "N4_keyword_warnings": n4_warnings, "N5_hard_errors": n5_hard_errors, "N6_unsafe_bounds": n6_unsafe_bounds, "N7_fractional_multiple_of": n7_fractional_steps,
    "N8_unresolved_refs": n8_unresolved_refs, "N9_dialect_check": n9_dialects, "N10_normalised": n10_normalised, "N12_irrelevant_keywords": n12_irrelevant, "C3_grade_warnings": c3_grade_warnings,
    "T1_manifest_errors": t1_manifest_errors, "T5_writer_schema": t5_writer_schema, "T6_reader_schema": t6_reader_schema, "T7_rewritten_refs": t7_rewritten_refs, "O3_parameter_overrides": o3_overrides,
    "O11_duplicate_media": o11_duplicate_media, "O12_response_headers": o12_response_headers, "O13_unsupported_surfaces": o13_unsupported,
    **{k: _rule(*rule[:2]) for k, rule in RULES.items()}, "N16_union_forms": n16_unions, "R37_refuted_unknowns": r37_refuted, "G9_rejection": g9_rejection, **{k: _generated(c) for k, c in GENERATED.items()},
}
_USERS = "(SELECT DISTINCT user_id AS stable_id FROM events WHERE user_id IS NOT NULL)"
_ENVELOPE = """'{"$defs":{"v' || version || '":' || schema_json || '},"additionalProperties":false,"properties":{"data":{"$ref":"#/$defs/v' || version || '"},"version":{"const":' || version || '}},"required":["version","data"],"type":"object"}'"""
_API = "(SELECT page_id, '/a' AS path, 'POST' AS method FROM pages WHERE strpos(url, '://') > 0)"
_COUNTS = "n AS (SELECT user_id AS stable_id, count(event_id) FILTER (WHERE event_id % 2 = 0) % 7 AS a, count(event_id) FILTER (WHERE event_id % 2 = 1) % 7 AS b FROM events WHERE user_id IS NOT NULL GROUP BY 1)"


def _rule_sql(within: str, around: str, else_within: str = "incompatible", else_around: str = "incompatible") -> str:
    verdict = "CASE WHEN coalesce({0}, false) THEN 'compatible' ELSE '{1}' END AS verdict"
    return f"WITH {_COUNTS} SELECT stable_id, 'serializer' AS direction, {verdict.format(within, else_within)} FROM n UNION ALL SELECT stable_id, 'deserializer', {verdict.format(around, else_around)} FROM n"


_WARN = "CASE WHEN ({0}) % 7 = 0 THEN '{1}: #/properties/text contentEncoding' END"
ORACLE_SQL = {
    "N3_pointers": f"SELECT '#/$defs/a~1b' AS pointer, count(*) AS n FROM {_USERS}",
    "N4_keyword_warnings": f"SELECT stable_id, '#/properties/text' AS pointer, 'contentEncoding' AS keyword FROM {_USERS} WHERE stable_id % 7 = 0",
    "N5_hard_errors": f"SELECT stable_id, '#/properties/text' AS pointer, '$anchor' AS keyword FROM {_USERS} WHERE stable_id % 7 = 1",
    "N6_unsafe_bounds": f"SELECT stable_id, '#/properties/big' AS pointer, 'maximum' AS keyword, CAST(stable_id % 4 + {registry_scan.SAFE} AS BIGINT) AS value FROM {_USERS} WHERE stable_id % 2 = 1",
    "N7_fractional_multiple_of": f"SELECT stable_id, '#/properties/step' AS pointer, 0.5::DOUBLE AS value FROM {_USERS} WHERE stable_id % 2 = 1",
    "N8_unresolved_refs": f"SELECT stable_id, '#/properties/ref' AS pointer, CASE stable_id % 3 WHEN 1 THEN '#/$defs/gone' ELSE 'other.json' END AS target FROM {_USERS} WHERE stable_id % 3 <> 0",
    "N9_dialect_check": f"SELECT stable_id, 'http://json-schema.org/draft-07/schema#' AS dialect FROM {_USERS} WHERE stable_id % 5 = 0",
    "N10_normalised": f"""SELECT stable_id, '#' AS pointer, '' AS enum_values, 'ref,text' AS required_names FROM {_USERS}
        UNION ALL SELECT stable_id, '#/properties/kind', CASE stable_id % 2 WHEN 0 THEN '"a","b"' ELSE '"a"' END, '' FROM {_USERS}""",
    "N16_union_forms": f"""SELECT stable_id, '#/properties/a' AS pointer, 'types' AS form, 'null,string' AS branches FROM {_USERS}
        UNION ALL SELECT stable_id, '#/properties/b', CASE stable_id % 2 WHEN 0 THEN 'anyOf' ELSE 'oneOf' END, '#/properties/b/oneOf/0,#/properties/b/oneOf/1' FROM {_USERS}""",
    "N12_irrelevant_keywords": f"SELECT stable_id, '#/properties/text' AS pointer, 'minimum' AS keyword FROM {_USERS} WHERE stable_id % 6 = 0",
    "C3_grade_warnings": f"SELECT stable_id, concat_ws(';', {_WARN.format('stable_id', 'old')}, {_WARN.format('stable_id + 1', 'new')}) AS warnings FROM {_USERS} WHERE stable_id % 7 IN (0, 6)",
    "T1_manifest_errors": f"""WITH {_REG} SELECT stable_id, 'hash does not match' AS error, count(*) AS n FROM reg WHERE stable_id % 10 = 0 GROUP BY 1
        UNION ALL SELECT stable_id, 'versions must rise', count(*) - 1 FROM reg WHERE stable_id % 9 = 0 GROUP BY 1 HAVING count(*) > 1""",
    "T5_writer_schema": f"WITH {_REG} SELECT stable_id, version, {_ENVELOPE} AS envelope FROM reg",
    "T6_reader_schema": f"""WITH {_REG} SELECT stable_id, '{{"oneOf":[' || string_agg({_ENVELOPE}, ',' ORDER BY version DESC) || ']}}' AS envelope FROM reg GROUP BY 1""",
    "T7_rewritten_refs": f"SELECT stable_id, CASE stable_id % 3 WHEN 0 THEN '#/$defs/v3/$defs/a~1b' WHEN 1 THEN '#/$defs/v3/$defs/gone' END AS inner_ref, CASE WHEN stable_id % 3 < 2 THEN '#/$defs/v3' END AS outer_ref FROM {_USERS}",
    "O3_parameter_overrides": CODEC_SQL["O2_parameters"],
    "O11_duplicate_media": f"SELECT page_id, path, method, 'application/json' AS media, 2::BIGINT AS n FROM {_API} WHERE page_id % 3 = 0",
    "O12_response_headers": f"""SELECT page_id, path, method, '200' AS entry, 'x-id' AS header, CASE page_id % 4 WHEN 0 THEN 2 ELSE 1 END::BIGINT AS n FROM {_API}
        UNION ALL SELECT page_id, path, method, '200', 'link', 1 FROM {_API} WHERE page_id % 4 <> 0""",
    "O13_unsupported_surfaces": f"""SELECT page_id, 'POST /a' AS place, 'callbacks' AS surface FROM {_API} WHERE page_id % 5 = 0 UNION ALL SELECT page_id, 'sent', 'webhook' FROM {_API} WHERE page_id % 6 = 0
        UNION ALL SELECT page_id, '/b', 'path reference' FROM {_API} WHERE page_id % 7 = 0""",
    **{k: _rule_sql(*rule[2:]) for k, rule in RULES.items()},
    "R37_refuted_unknowns": " UNION ALL ".join(f"SELECT '{k}' AS rule, * FROM ({_rule_sql(*RULES[k][2:4])})" for k in REFUTED),
    "G9_rejection": "SELECT 'found' AS status, count(*) AS n, count(*) AS right, true AS some_again FROM customer",
    **{k: "SELECT c_mktsegment, count(*) AS n, count(*) AS accepted FROM customer GROUP BY 1" for k in GENERATED},
}
