import json

import pytest
from pyspark.sql import functions as F

from pactlake.functions.predicates import compile_contract, pattern_supported, resolve
from pactlake.functions.values import Variant
from pactlake.operators import codec, compat, generate, openapi, registry_scan, stamping
from pactlake.operators.validation import split_valid, validate
from pactlake.sources import files

CASES = [
    ({"minimum": 3}, ["3", "3.5", '"x"', "null"], ["2", "2.9"]),
    ({"type": "integer"}, ["1", "1.0", "-7"], ["1.5", '"1"', "true"]),
    ({"type": ["string", "null"]}, ['"a"', "null"], ["1", "[]"]),
    ({"enum": [1, "a", None]}, ["1", "1.0", '"a"', "null"], ["2", '"b"', "false"]),
    ({"const": {"a": [1]}}, ['{"a":[1]}'], ['{"a":[2]}', "1"]),
    ({"multipleOf": 0.01}, ["4.02", "0", '"x"'], ["0.0075"]),
    ({"uniqueItems": True}, ["[1,2]", "[]", "3"], ["[1,1]", "[1,1.0]"]),
    ({"prefixItems": [{"type": "string"}], "items": {"type": "number"}}, ['["a",1]', "[]", '["a"]'], ['["a","b"]', "[1]"]),
    ({"contains": {"const": 5}, "maxContains": 1}, ["[5]", "[1,5]"], ["[]", "[5,5]"]),
    ({"oneOf": [{"minimum": 5}, {"multipleOf": 2}]}, ["6.5", "4"], ["3", "6"]),
    ({"not": {"type": "string"}}, ["1"], ['"a"']),
    ({"if": {"required": ["a"]}, "then": {"required": ["b"]}}, ["{}", '{"a":1,"b":2}'], ['{"a":1}']),
    ({"required": ["a"]}, ['{"a":null}', "1"], ["{}"]),
    ({"dependentSchemas": {"a": {"maxProperties": 1}}}, ['{"a":1}', '{"b":1,"c":2}'], ['{"a":1,"b":2}']),
    ({"properties": {"a": True}, "additionalProperties": False}, ['{"a":1}', "{}"], ['{"b":1}']),
    ({"patternProperties": {"^x": {"type": "string"}}}, ['{"x1":"s","y":1}'], ['{"x1":1}']),
    ({"propertyNames": {"maxLength": 2}}, ['{"ab":1}'], ['{"abc":1}']),
    ({"allOf": [{"properties": {"a": True}}], "unevaluatedProperties": False}, ['{"a":1}'], ['{"b":1}']),
    ({"prefixItems": [True], "unevaluatedItems": False}, ["[1]"], ["[1,2]"]),
    ({"$defs": {"a/b": {"minimum": 2}}, "$ref": "#/$defs/a~1b"}, ["2"], ["1"]),
    ({"properties": {"next": {"$ref": "#"}, "v": {"type": "integer"}}, "required": ["v"]}, ['{"v":1,"next":{"v":2}}'], ['{"v":1,"next":{}}']),
    (False, [], ["1", "{}"]),
    ({}, ["1", "null"], []),
    ({"maximum": 2**53}, ["9007199254740992", "9007199254740992.0"], ["9007199254740993", "9007199254740992.5"]),
    ({"exclusiveMinimum": 2**53}, ["9007199254740993"], ["9007199254740992"]),
    ({"const": 2**53 + 1}, ["9007199254740993"], ["9007199254740992"]),
    ({"multipleOf": 2}, ["9007199254740994", "1e3"], ["9007199254740993"]),
    ({"type": "integer"}, ["12345678901234567890123", "1e3"], ["12345678901234567890.5"]),
    ({"uniqueItems": True}, ["[9007199254740992,9007199254740993]", '[[1],[true]]', '["1.0]","1]"]'], ["[9007199254740993,9007199254740993.0]", "[[1e0],[1]]"]),
    ({"const": 12345678901234567890123456789}, ["12345678901234567890123456789"], ["1"]),
    ({"required": ["a'b", 'c"d', "e\\f"]}, ['{"a\'b":1,"c\\"d":2,"e\\\\f":3}'], ['{"a\'b":1}']),
    ({"properties": {"a'b": {"type": "string"}}, "dependentRequired": {"x'": ["y"]}}, ['{"a\'b":"s"}'], ['{"a\'b":1}', '{"x\'":1}']),
    ({"pattern": "a$"}, ['"ba"', '"a"'], ['"ba\\n"', '"ab"']),
    ({"pattern": "[$]"}, ['"$"'], ['"a"']),
    ({"$defs": {"p": {"prefixItems": [True]}}, "$ref": "#/$defs/p", "contains": {"type": "string"}, "unevaluatedItems": False}, ['[1,"a","b"]'], ['[1,"a",2]']),
    ({"allOf": [{"prefixItems": [True], "unevaluatedItems": {"type": "null"}}], "unevaluatedItems": False}, ["[1,null,null]"], ["[1,2]"]),
    ({"$defs": {f"d{i}": {"$ref": f"#/$defs/d{i + 1}"} for i in range(8)} | {"d8": {"maximum": 3}}, "$ref": "#/$defs/d0"}, ["3", '"x"'], ["4"]),
    ({"properties": {"next": {"$ref": "#"}, "v": {"type": "integer"}}, "not": {"required": ["w"]}}, ['{"v":1,"next":' * 4 + "{}" + "}" * 4], ['{"next":' * 3 + '{"w":1}' + "}" * 3]),
]


@pytest.mark.parametrize("schema,good,bad", CASES, ids=[json.dumps(c[0])[:40] for c in CASES])
def test_keyword(spark, schema, good, bad):
    df = spark.createDataFrame([(t, True) for t in good] + [(t, False) for t in bad], "t string, want boolean")
    rows = df.withColumn("got", compile_contract(schema, Variant(F.parse_json("t")))).collect()
    assert [(r.t, r.got) for r in rows if r.got != r.want] == []


def test_failed_checks_name_keyword_and_pointer(spark):
    df = spark.createDataFrame([('{"a/b":5}',)], "t string").select(F.parse_json("t").alias("v"))
    row = validate(df, "v", {"properties": {"a/b": {"maximum": 3}}, "required": ["c"]}).first()
    assert not row.valid and {(f.keyword, f.pointer) for f in row.failed} == {("required", "#/required"), ("maximum", "#/properties/a~1b/maximum")}


def test_what_lies_too_deep_is_not_decided(spark):
    """A list of 12 nodes is longer than the bound: NULL, unless something within the bound decides; not is no way out."""
    chain = lambda leaf, n=12: '{"next":' * n + leaf + "}" * n
    schema = {"properties": {"next": {"$ref": "#"}, "v": {"type": "integer"}}}
    rows = [(chain("{}"), None), (chain('{"v":"x"}'), None), (chain("{}", 3), True), ('{"v":"x","next":' + chain("{}") + "}", False)]
    df = spark.createDataFrame(rows, "t string, want boolean").withColumn("doc", F.parse_json("t"))
    got = validate(df, "doc", schema).withColumn("negated", compile_contract({"not": {"$ref": "#/$defs/n"}, "$defs": {"n": {"properties": {"next": {"$ref": "#/$defs/n"}, "v": {"type": "integer"}}}}}, Variant(F.col("doc"))))
    for r in got.collect():
        assert r.valid is r.want and r.negated is (None if r.want is None else not r.want)
    good, rest = split_valid(df, "doc", schema)
    assert (good.count(), rest.count()) == (1, 3)


def test_references_and_patterns():
    assert resolve({"a": [{"b%": 1}]}, "#/a/0/b%25") == 1
    with pytest.raises(ValueError):
        resolve({}, "other.json#/a")
    assert pattern_supported("^a+$") and not pattern_supported("(")


def deep(levels, leaf):
    return {"properties": {"x": deep(levels - 1, leaf)}} if levels else leaf


PAIRS = [
    ({"type": "integer", "minimum": 5}, {"enum": [3]}, "incompatible", "incompatible"),
    ({"type": ["integer", "string"], "minimum": 5, "maxLength": 2}, {"enum": [7, "ab"]}, "compatible", "incompatible"),
    ({"pattern": "^a"}, {"enum": ["ab"]}, "compatible", "incompatible"),
    ({"enum": ["ab", "b"], "pattern": "^a"}, {"enum": ["b"]}, "incompatible", "incompatible"),
    ({"enum": [{"a": 1}]}, {"enum": [{"a": 1}], "properties": {"a": {"minimum": 5}}}, "compatible", "unknown"),
    ({"maximum": 2**53}, {"maximum": 2**53 + 1}, "incompatible", "compatible"),
    ({"minLength": 3}, {"type": "integer"}, "compatible", "incompatible"),
    ({"enum": [False, True]}, {"type": "boolean"}, "compatible", "compatible"),
    ({"enum": [1, 2, 3]}, {"type": "integer", "minimum": 2, "maximum": 2}, "compatible", "incompatible"),
    ({"type": "integer", "multipleOf": 1}, {"type": "integer"}, "compatible", "compatible"),
    ({"type": "integer"}, {"type": "number", "multipleOf": 2}, "compatible", "incompatible"),
    ({"type": "object", "properties": {"a": True}}, {"type": "object"}, "compatible", "compatible"),
    ({"type": "string"}, False, "compatible", "incompatible"),
    ({"required": ["a"]}, {}, "incompatible", "compatible"),
    ({"type": "integer"}, {"type": "number"}, "incompatible", "compatible"),
    ({"type": "string"}, {"type": ["string", "null"]}, "incompatible", "compatible"),
    ({"enum": ["a", "b"]}, {"enum": ["a"]}, "compatible", "incompatible"),
    ({"minimum": 1}, {"exclusiveMinimum": 1}, "compatible", "incompatible"),
    ({"type": "integer", "minimum": 1}, {"type": "integer", "exclusiveMinimum": 0}, "compatible", "compatible"),
    ({"multipleOf": 2}, {"multipleOf": 6}, "compatible", "incompatible"),
    ({"format": "date"}, {"format": "time"}, "compatible", "compatible"),
    ({"properties": {"a": {"type": "string"}}, "additionalProperties": False}, {"properties": {"a": {"type": "string"}, "b": {"type": "string"}}, "additionalProperties": False}, "incompatible", "compatible"),
    ({"properties": {"a": {"type": "string"}}}, {"properties": {"a": {"type": "string"}}, "additionalProperties": False}, "compatible", "incompatible"),
    ({"uniqueItems": True}, {"maxItems": 1}, "compatible", "incompatible"),
    ({"$defs": {"a": {"minimum": 1}}, "properties": {"x": {"$ref": "#/$defs/a"}}}, {"$defs": {"a": {"minimum": 9}}, "properties": {"x": {"$ref": "#/$defs/a"}}}, "compatible", "incompatible"),
    ({"anyOf": [{"type": "string"}, {"type": "null"}]}, {"type": ["null", "string"]}, "compatible", "compatible"),
    ({"oneOf": [{"type": "string"}, {"type": "integer"}]}, {"type": "integer"}, "compatible", "incompatible"),
    ({"allOf": [{"minimum": 1}, {"maximum": 5}]}, {"type": "integer", "minimum": 2, "maximum": 4}, "compatible", "incompatible"),
    ({"not": {"type": "string"}}, {"type": "integer"}, "compatible", "incompatible"),
    ({"$defs": {"n": {"properties": {"n": {"$ref": "#/$defs/n"}, "v": {"type": "integer"}}}}, "$ref": "#/$defs/n"}, {"$defs": {"m": {"properties": {"n": {"$ref": "#/$defs/m"}, "v": {"type": "number"}}}}, "$ref": "#/$defs/m"}, "incompatible", "compatible"),
    ({"$ref": "#/$defs/gone"}, {"type": "integer"}, "unknown", "unknown"),
    ({"type": "object", "patternProperties": {"^x": {"type": "integer"}}}, {"type": "object", "properties": {"x1": {"type": "integer"}}, "additionalProperties": False}, "compatible", "incompatible"),
    ({"type": "array", "contains": {"type": "integer"}}, {"type": "array", "items": {"type": "integer"}, "minItems": 1}, "compatible", "incompatible"),
    ({"type": "array", "items": {"type": "integer"}}, {"type": "array"}, "incompatible", "compatible"),
    ({"additionalProperties": {"type": "integer"}}, {}, "incompatible", "compatible"),
    ({"additionalProperties": {"type": "integer"}}, {"properties": {"a": {"type": "integer"}}, "additionalProperties": {"type": "integer"}}, "compatible", "compatible"),
    ({"required": ["a"], "dependentRequired": {"a": ["b"]}}, {"required": ["a", "b"]}, "compatible", "compatible"),
    ({"type": "object", "properties": {"a": False}, "required": ["a"]}, {"type": "object"}, "incompatible", "compatible"),
    ({"anyOf": [{"type": "string"}], "maxProperties": 3}, {"anyOf": [{"type": "string"}], "maxProperties": 2}, "compatible", "compatible"),
    (deep(9, {"minimum": 1}), deep(9, {"minimum": 2}), "compatible", "incompatible"),
    ({"anyOf": [{"minimum": 1}]}, {"anyOf": [{"minimum": 2}]}, "compatible", "incompatible"),
    ({"type": "array", "contains": {"type": "integer"}}, {"type": "array", "contains": {"type": "integer", "minimum": 3}}, "compatible", "unknown"),
    ({"type": "integer", "minimum": 1, "maximum": 3}, {"enum": [1, 2, 3]}, "compatible", "compatible"),
    ({"type": "integer", "minimum": 1, "maximum": 3}, {"enum": [1, 2, "x"]}, "incompatible", "incompatible"),
    ({"type": ["integer", "null", "boolean"], "minimum": 1, "maximum": 4, "multipleOf": 2}, {"enum": [2, 4, None, True, False, 9]}, "incompatible", "compatible"),
    ({"type": "array", "items": {"type": "boolean"}, "uniqueItems": True}, {"type": "array", "items": {"type": "boolean"}, "uniqueItems": True, "maxItems": 2}, "compatible", "compatible"),
    ({"type": "array", "items": {"type": "boolean"}, "uniqueItems": True}, {"type": "array", "items": {"type": "boolean"}, "uniqueItems": True, "maxItems": 1}, "compatible", "incompatible"),
    ({"type": "array", "items": {"type": "integer", "minimum": 1, "maximum": 3}, "uniqueItems": True}, {"type": "array", "items": {"type": "integer"}, "maxItems": 3}, "incompatible", "compatible"),
    ({"type": "integer", "minimum": 0, "maximum": 10}, {"anyOf": [{"type": "integer", "minimum": 6, "maximum": 10}, {"type": "integer", "minimum": 0, "maximum": 5}]}, "compatible", "compatible"),
    ({"type": "number", "minimum": 0, "maximum": 10}, {"anyOf": [{"type": "number", "minimum": 6, "maximum": 10}, {"type": "number", "minimum": 0, "maximum": 5}]}, "compatible", "incompatible"),
    ({"type": "number", "minimum": 0, "maximum": 10}, {"anyOf": [{"type": "number", "minimum": 5}, {"type": "number", "exclusiveMaximum": 5}]}, "incompatible", "compatible"),
    ({"type": "number"}, {"anyOf": [{"type": "number", "exclusiveMinimum": 5}, {"type": "number", "exclusiveMaximum": 5}]}, "compatible", "incompatible"),
    ({"type": "integer"}, {"anyOf": [{"type": "integer", "minimum": 1}, {"type": "integer", "maximum": 0}, {"type": "string"}]}, "incompatible", "compatible"),
    ({"type": "string", "maxLength": 3}, {"oneOf": [{"type": "string", "maxLength": 4}, {"type": "string", "minLength": 5}, {"type": "null"}]}, "unknown", "compatible"),
    ({"type": "string", "maxLength": 5}, {"oneOf": [{"type": "string", "maxLength": 5}, {"type": "string", "minLength": 5}]}, "unknown", "unknown"),
    ({"type": "array", "maxItems": 1}, {"oneOf": [{"type": "array", "minItems": 2}, {"type": "array", "maxItems": 1}]}, "unknown", "compatible"),
    ({"type": "object", "properties": {"k": {"const": "a"}}, "required": ["k"]}, {"oneOf": [{"type": "object", "properties": {"k": {"const": "a"}}, "required": ["k"]}, {"type": "object", "properties": {"k": {"enum": ["b", "c"]}}}]}, "unknown", "compatible"),
    ({"type": "integer", "minimum": 3, "maximum": 3}, {"anyOf": [{"type": "number", "exclusiveMinimum": 3}, {"type": "number", "exclusiveMaximum": 3}]}, "incompatible", "incompatible"),
]


def test_compatibility_rules(spark):
    rows = [(i, "both", json.dumps(o), json.dumps(n)) for i, (o, n, _, _) in enumerate(PAIRS)]
    got = {(r.pair, r.direction): r.verdict for r in compat.check_compat(spark.createDataFrame(rows, "pair int, role string, old string, new string"), ["pair"]).collect()}
    want = {(i, d): v for i, p in enumerate(PAIRS) for d, v in zip(("serializer", "deserializer"), p[2:], strict=True)}
    assert {k: (got[k], v) for k, v in want.items() if got[k] != v} == {}


def test_grades_and_gate(spark):
    cols = "id string, mode string, schema_json string, stable_id string"
    old = spark.createDataFrame([("a", "both", "{}", "a"), ("b", "both", '{"minimum":1}', "b"), ("c", "serializer", '{"minimum":1}', "c"), ("e", "both", '{"$id":"x"}', "e")], cols)
    new = spark.createDataFrame([("a", "both", "{ }", "a"), ("b", "both", '{"minimum":2}', "b"), ("c", "serializer", '{"minimum":2}', "c"), ("d", "both", "{}", "d"), ("e", "both", "{}", "e")], cols)
    grades = compat.grade(old, new)
    assert {r.id: r.status for r in grades.collect()} == {"a": "identical", "b": "incompatible", "c": "ok", "d": "missing_old", "e": "invalid"}
    assert compat.gate(grades).first().failed


def test_registry_findings(spark):
    doc = {"$schema": "http://old#", "$id": "x", "properties": {"a~b": {"maximum": 2**60, "type": "number"}, "c": {"$ref": "#/$defs/no"}, "d": {"type": "string", "minimum": 1}, "e": {"multipleOf": 0.5}}}
    nodes = registry_scan.schema_nodes(spark.createDataFrame([(1, json.dumps(doc)), (2, "{")], "id int, schema_json string"), ["id"])
    cons = registry_scan.constraints(nodes, ["id"])
    assert {r.pointer for r in nodes.collect()} == {"#", "#/properties/a~0b", "#/properties/c", "#/properties/d", "#/properties/e"}
    assert [r.keyword for r in registry_scan.keyword_findings(nodes, ["id"], registry_scan.HARD).collect()] == ["$id"]
    assert [r.pointer for r in registry_scan.unsafe_bounds(cons, ["id"]).collect()] == ["#/properties/a~0b"]
    assert [r.target for r in registry_scan.unresolved_refs(cons, nodes, ["id"]).collect()] == ["#/$defs/no"]
    assert [r.keyword for r in registry_scan.irrelevant_keywords(cons, ["id"]).collect()] == ["minimum"]
    assert registry_scan.fractional_multiple_of(cons).count() == 1 and registry_scan.dialect_findings(cons).count() == 1


def test_stamping_round(spark):
    hist = spark.createDataFrame([("a", 1, '{"minimum":1}', 0), ("b", 1, "{}", 0)], "stable_id string, version int, schema_json string, ordinal int").withColumn("schema_sha256", registry_scan.canonical_hash(F.col("schema_json")))
    assert stamping.manifest_errors(hist).count() == 0
    new = spark.createDataFrame([("a", '{"minimum":2}'), ("b", "{ }"), ("c", "{}")], "stable_id string, schema_json string")
    stamped = stamping.stamp_batch(hist, new)
    assert {(r.stable_id, r.status, r.version) for r in stamped.collect()} == {("a", "breaking_change", 2), ("b", "unchanged", 1), ("c", "new", 1)}
    after = stamping.next_manifest(hist, stamped)
    assert after.count() == 4
    one = json.loads(stamping.reader_schema(after).filter("stable_id = 'a'").first().schema_json)["oneOf"]
    assert [x["properties"]["version"]["const"] for x in one] == [2, 1]


def test_generated_values_are_valid_and_stable(spark):
    schema = {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": "integer", "minimum": 3, "maximum": 90, "multipleOf": 3}, "b": {"type": "string", "minLength": 2, "maxLength": 4}, "c": {"type": "array", "items": {"enum": [1, "x"]}, "maxItems": 3}, "d": {"type": "string", "format": "date"}}}
    rows = generate.generate(spark, schema, 50, attempts=3).collect()
    assert all(r.value is not None and 3 <= json.loads(r.value)["a"] <= 90 for r in rows)
    again = generate.generate(spark.newSession(), schema, 50, attempts=3).collect()
    assert sorted(rows) == sorted(again)


def test_codec_keeps_missing_null_and_extras(spark):
    schema = {"properties": {"a": {"type": ["integer", "null"]}, "b": {"type": "string"}}}
    df = spark.createDataFrame([(1, '{"a":null,"z":{"y":1}}'), (2, '{"b":"x"}'), (3, '{"a":1,"a":2}')], "id int, t string")
    good, bad = codec.decode(df, "t", schema, ["id"])
    assert {r.id: sorted(r.present) for r in good.collect()} == {1: ["a"], 2: ["b"]} and [r.id for r in bad.collect()] == [3]
    assert codec.round_trip_audit(df, "t", schema, ["id"]).filter("NOT same").count() == 0


def test_codec_keeps_whole_numbers_and_tells_variant_nulls(spark):
    schema = {"properties": {"a": {"type": "integer"}, "b": {"type": ["number", "null"]}, "c'd": {"type": "string"}}}
    df = spark.createDataFrame([(1, '{"a":9007199254740993,"b":null}'), (2, '{"a":7.0,"b":1,"c\'d":"x"}'), (3, "{}")], "id int, t string")
    good, _ = codec.decode(df, "t", schema, ["id"])
    rows = {r.id: r for r in good.select("*", codec.is_null("b").alias("null"), codec.is_missing("b").alias("missing")).collect()}
    assert [rows[i].a for i in (1, 2, 3)] == [9007199254740993, 7, None]
    assert [(rows[i].null, rows[i].missing) for i in (1, 2, 3)] == [(True, False), (False, False), (False, True)]
    assert rows[2]["c'd"] == "x" and codec.round_trip_audit(df, "t", schema, ["id"]).filter("NOT same").count() == 0


def test_generation_tells_unsatisfiable_from_exhausted(spark):
    ends = [generate.generate(spark, s, 3, attempts=7).collect() for s in (False, {"type": "integer", "minimum": 1, "maximum": 3, "not": {"type": "integer"}}, {"type": "boolean"})]
    assert [{(r.status, r.tried) for r in rows} for rows in ends] == [{("unsatisfiable", 0)}, {("exhausted", 7)}, {("found", 1)}]


def test_registry_cycles_and_deep_nodes(spark):
    doc = {"$defs": {"a": {"$ref": "#/$defs/b"}, "b": {"$ref": "#/$defs/a"}, "c": {"$ref": "#/$defs/d"}, "d": {}, "e": {"$ref": "#/$defs/%zz+"}}, **deep(9, {"$id": "far"})}
    nodes = registry_scan.schema_nodes(spark.createDataFrame([(1, json.dumps(doc))], "id int, schema_json string"), ["id"])
    assert [r.pointer.count("/x") for r in registry_scan.keyword_findings(nodes, ["id"], registry_scan.HARD).collect()] == [9]
    found = registry_scan.unresolved_refs(registry_scan.constraints(nodes, ["id"]), nodes, ["id"])
    assert {(r.pointer[-1], r.target) for r in found.collect()} == {("a", "#/$defs/b"), ("b", "#/$defs/a"), ("e", "#/$defs/%zz+")}


def test_openapi_media_and_detection(spark):
    df = spark.createDataFrame([('{"openapi":"3.1.0","paths":{}}', "text/Plain; charset=x"), ("[]", "image/png")], "doc_json string, m string")
    rows = df.select(openapi.is_openapi().alias("is"), openapi.media_covered(F.array(F.lit("text/*"), F.lit("*/*")), F.col("m")).alias("by")).collect()
    assert [(r["is"], r["by"]) for r in rows] == [(True, "text/*"), (False, "*/*")]


def test_files_round(spark, tmp_path):
    (tmp_path / "golden.json").write_text('{"x": {"mode": "both", "schema": {"minimum": 1}}}')
    assert files.read_golden(spark, str(tmp_path / "golden.json")).first().asDict() == {"id": "x", "mode": "both", "schema_json": '{"minimum":1}', "stable_id": "x"}
    (tmp_path / "r.jsonl").write_text('{"a":1}\n{bad\n')
    good, bad = files.read_records(spark, str(tmp_path / "r.jsonl"))
    assert (good.count(), bad.count()) == (1, 1)
    (tmp_path / "m.json").write_text('{"manifest_version":1,"schemas":{"x":{"stable_id":"x","versions":[{"version":1,"schema_sha256":"h","schema":{}},{"version":2,"schema_sha256":"h","schema":{}}]}}}')
    history = files.read_manifest(spark, str(tmp_path / "m.json"))
    assert [r.version for r in history.orderBy("ordinal").collect()] == [1, 2]
    files.write_manifest(history, str(tmp_path / "out"))
    again = files.read_manifest(spark, str(tmp_path / "out"))
    assert sorted(map(str, again.collect())) == sorted(map(str, history.collect())) and again.count() == 2
