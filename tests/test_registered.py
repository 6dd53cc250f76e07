"""Contracts as rows: the keyword cases of test_contracts in one job, values for them, and counterexamples."""

import json

import pytest
from pyspark.sql import functions as F
from test_contracts import CASES, PAIRS

from pactlake.operators import compat, registry_generation, registry_scan, registry_validation, stamping
from pactlake.sources import files

#: What rows leave undecided: unevaluated keywords, and a pattern with a class that isn't among the plain ones.
OPEN = [i for i, (s, _, _) in enumerate(CASES) if "unevaluated" in json.dumps(s) or s == {"pattern": "[$]"}]


@pytest.fixture(scope="module")
def contracts(spark):
    return spark.createDataFrame([(i, json.dumps(s)) for i, (s, _, _) in enumerate(CASES)], "c int, schema_json string")


def test_keyword_cases_in_one_job(spark, contracts):
    texts = [(i, t, w) for i, (_, good, bad) in enumerate(CASES) for t, w in [*((x, True) for x in good), *((x, False) for x in bad)]]
    records = spark.createDataFrame([*texts, (0, "{", False), (0, None, False), (-1, "1", None)], "c int, t string, want boolean")
    rows = registry_validation.judge_records(records.withColumn("value", F.lit("clash")), contracts, ["c"], "t").collect()
    assert len(rows) == len(texts) + 3
    assert [(r.c, r.t, r.valid) for r in rows if r.valid != r.want and not (r.valid is None and r.c in OPEN)] == []


def test_values_fit_their_contracts(spark, contracts):
    made = registry_generation.generate_registered(contracts, ["c"], attempts=(8, 64))
    rows = {r.c: r for r in made.collect()}
    assert {i for i, r in rows.items() if r.status == "exhausted"} == {*OPEN, CASES.index((False, [], ["1", "{}"]))}
    again = registry_validation.judge_records(made.filter("value IS NOT NULL").select("c", "value"), contracts, ["c"], "value").collect()
    assert len(again) == sum(r.status == "found" for r in rows.values()) and all(r.valid for r in again)


def test_counterexamples_agree_with_verdicts(spark):
    """No witness against a pair that is compatible; one for nearly every pair that isn't."""
    pairs = spark.createDataFrame([(i, "both", json.dumps(o), json.dumps(n)) for i, (o, n, _, _) in enumerate(PAIRS)], "pair int, role string, old string, new string")
    got = {(r.pair, r.direction): r.witness for r in registry_generation.counterexamples(pairs, ["pair"], attempts=(16, 64)).collect()}
    want = {(i, d): v for i, p in enumerate(PAIRS) for d, v in zip(("serializer", "deserializer"), p[2:], strict=True)}
    # Serializer only: values with undeclared keys count there, so "compatible" leaves no witness at all.
    assert [k for k in got if want[k] == "compatible" and k[1] == "serializer"] == []
    wrong = {k for k, v in want.items() if v == "incompatible"}
    assert len(wrong - set(got)) <= 4, {k: PAIRS[k[0]][:2] for k in wrong - set(got)}
    first = registry_generation.first_counterexamples(pairs.filter("pair IN (0, 1, 3)"), ["pair"], attempts=(16,)).collect()
    assert {r.pair: r.direction for r in first} == {0: "serializer", 1: "deserializer", 3: "serializer"}


def test_contracts_without_records_and_empty_tables(spark, contracts):
    none = spark.createDataFrame([], "c int, t string")
    assert registry_validation.judge_records(none, contracts, ["c"], "t").count() == 0
    assert registry_generation.generate_registered(contracts.limit(0), ["c"]).count() == 0
    assert registry_generation.counterexamples(spark.createDataFrame([], "pair int, role string, old string, new string"), ["pair"]).count() == 0


def test_envelopes_by_id_and_version(spark):
    history = spark.createDataFrame([("a", 1, '{"type":"integer"}'), ("a", 2, '{"type":"string"}'), ("b", 1, "{}")], "stable_id string, version int, schema_json string")
    texts = ['{"version":1,"data":1}', '{"version":2,"data":1}', '{"version":2,"data":"x"}', '{"version":3,"data":1}', '{"version":1,"data":1,"x":0}', '{"version":1}', '{"version":"1","data":1}', "1", "{", None]
    records = spark.createDataFrame([(i, "a", t) for i, t in enumerate(texts)] + [(10, "b", texts[0]), (11, "c", texts[0])], "i int, stable_id string, e string")
    got = {r.i: r.valid for r in registry_validation.read_registered(records, history, "e").collect()}
    assert got == {i: i in (0, 2, 10) for i in range(12)}
    made = registry_validation.stamp_registered(spark.createDataFrame([("a", '"x"'), ("a", "1"), ("c", "1")], "stable_id string, d string"), history, "d").collect()
    assert [json.loads(r.envelope) for r in made] == [{"version": 2, "data": "x"}]


def test_deep_documents_take_passes_of_one_size(spark):
    """100 levels of properties, and a constant of 500 nested lists, which is one node."""
    doc: dict = {"$id": "far"}
    for _ in range(100):
        doc = {"properties": {"x": doc}}
    nested: list = []
    for _ in range(499):
        nested = [nested]
    text = lambda x: json.dumps(x)
    reg = spark.createDataFrame([(1, text(doc)), (2, text({"const": nested})), (3, text({"properties": {"a": {"items": {"not": {}}}}}))], "id int, schema_json string")
    nodes = registry_scan.schema_nodes(reg, ["id"])
    counts = {r.id: r["count"] for r in nodes.groupBy("id").count().collect()}
    assert counts == {1: 101, 2: 1, 3: 4}
    assert [r.pointer for r in registry_scan.keyword_findings(nodes, ["id"], ("$id",)).collect()] == ["#" + "/properties/x" * 100]


def test_equal_pairs_are_judged_once(spark):
    rows = [(i, "both" if i % 2 else "serializer", '{"minimum":1}', '{"minimum":2}' if i % 3 else "{") for i in range(60)] + [(60, "both", None, "{}")]
    got = compat.check_compat(spark.createDataFrame(rows, "pair int, role string, old string, new string"), ["pair"]).collect()
    want = {(i, d): "unknown" if not new.startswith('{"') or old is None else "compatible" if d == "serializer" else "incompatible" for i, role, old, new in rows for d in (("serializer", "deserializer") if role == "both" else ("serializer",))}
    assert {(r.pair, r.direction): r.verdict for r in got} == want and len(got) == len(want)


def test_stamping_of_compatible_updates(spark):
    hist = spark.createDataFrame([("a", 1, '{"type":"object","properties":{"x":{"type":"integer"}}}')], "stable_id string, version int, schema_json string").withColumn("schema_sha256", registry_scan.canonical_hash(F.col("schema_json")))
    new = spark.createDataFrame([("a", '{"type":"object","properties":{"x":{"type":"integer"},"y":{}}}')], "stable_id string, schema_json string")
    stamped = stamping.stamp_batch(hist, new)
    assert [(r.status, r.version) for r in stamped.collect()] == [("compatible_update", 1)]
    assert [r.schema_json for r in stamping.next_manifest(hist, stamped).collect()] == [new.first().schema_json]


def test_manifests_that_are_not_right(spark, tmp_path):
    schema = '{"type":"integer"}'
    good = registry_scan.canonical_hash(F.lit(schema))
    rows = [("a", 1, 0, schema), ("a", 1, 1, schema), ("", 1, 0, schema), ("b", 1, 0, '{"$ref":"#/$defs/gone"}'), ("c", None, None, None), ("d", 1, 0, '{"type":"string"}')]
    hist = spark.createDataFrame(rows, "stable_id string, version int, ordinal int, schema_json string").withColumn("schema_sha256", F.when(F.col("stable_id") == "b", registry_scan.canonical_hash(F.col("schema_json"))).when(F.col("schema_json").isNotNull(), good))
    got = sorted((r.stable_id, r.version or 0, r.error) for r in stamping.manifest_errors(hist).collect())
    assert got == [("", 1, "empty stable_id"), ("a", 1, "versions must rise"), ("b", 1, "contract is not valid"), ("c", 0, "no versions"), ("d", 1, "hash does not match")]
    assert stamping.manifest_errors(hist.limit(0)).count() == 0
    (tmp_path / "m.json").write_text('{"manifest_version":2,"schemas":{"x":{"stable_id":"y","versions":[]}}}')
    assert sorted(r.error for r in stamping.manifest_errors(files.read_manifest(spark, str(tmp_path / "m.json"))).collect()) == ["key is not the stable_id", "no versions", "unknown manifest version"]
    # An id without versions is a new one, and leaves the manifest with its first version.
    new = stamping.stamp_batch(hist.filter("stable_id = 'c'"), spark.createDataFrame([("c", schema)], "stable_id string, schema_json string"))
    assert [(r.status, r.version) for r in new.collect()] == [("new", 1)]
    assert [(r.stable_id, r.version) for r in stamping.next_manifest(hist.filter("stable_id = 'c'"), new).collect()] == [("c", 1)]


def test_envelopes_only_of_references_by_pointer(spark):
    texts = ['{"$ref":"#"}', '{"$ref":"#/$defs/a"}', '{"$ref":"#a"}', '{"$ref":"b.json#/c"}', '{"properties":{"$ref":{"type":"string"}}}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.e for r in df.select("i", stamping.writer_schema(F.lit(2), F.col("t")).alias("e")).orderBy("i").collect()]
    assert [None if e is None else json.loads(e)["$defs"]["v2"] for e in got] == [{"$ref": "#/$defs/v2"}, {"$ref": "#/$defs/v2/$defs/a"}, None, None, json.loads(texts[4])]


def test_values_between_negated_bounds(spark):
    """Ranges of one or two numbers, said by what lies outside of them, are met within a few attempts."""
    outside = '{"type":"object","properties":{"v":{"type":"number","not":{"anyOf":[{"exclusiveMaximum":%d},{"exclusiveMinimum":%d}]}}},"required":["v"]}'
    reg = spark.createDataFrame([*((i, outside % (37 * i, 37 * i + i % 2)) for i in range(1, 5)), (5, '{"type":"integer","not":{"exclusiveMinimum":700},"minimum":700}')], "c int, schema_json string")
    assert {r.c: r.status for r in registry_generation.generate_registered(reg, ["c"], attempts=(8,)).collect()} == {i: "found" for i in range(1, 6)}


def test_proven_pairs_are_not_searched(spark, monkeypatch):
    """A pair without a counterexample ends the search; before, it went through all attempts."""
    calls, made = [], registry_generation.candidate_values
    monkeypatch.setattr(registry_generation, "candidate_values", lambda *a, **k: calls.append(a[2]) or made(*a, **k))
    texts = ['{"type":"object","properties":{"v":{"type":"number","minimum":%d,"maximum":9}}}' % i for i in (1, 5)]
    pairs = spark.createDataFrame([(0, "both", *texts)], "pair int, role string, old string, new string")
    got = registry_generation.counterexamples(pairs, ["pair"]).collect()
    assert [r.direction for r in got] == ["deserializer"] and calls == [16]


def test_records_are_judged_once_by_each_contract(spark, monkeypatch):
    """Three contracts in two pairs of both directions: three judgements of a record, before eight."""
    goals, judge = [], registry_validation.judge_parts
    monkeypatch.setattr(registry_validation, "judge_parts", lambda g, r: goals.append(g.count()) or judge(g, r))
    text = lambda hi: '{"type":"object","properties":{"v":{"maximum":%d}}}' % hi
    pairs = spark.createDataFrame([("a", 2, "both", text(1), text(5)), ("a", 3, "both", text(5), text(3))], "id string, version int, role string, old string, new string")
    records = spark.createDataFrame([("a", t) for t in ('{"v":0}', '{"v":2}', '{"v":4}', '{"v":4,"x":1}', "{", None)], "id string, t string")
    got = {(r.version, r.direction): (r.seen, r.witnesses) for r in registry_validation.data_compat_registered(records, pairs, "id", "t", ["id", "version"]).collect()}
    assert got == {(2, "serializer"): (4, 3), (2, "deserializer"): (1, 0), (3, "serializer"): (2, 0), (3, "deserializer"): (3, 1)}
    assert sum(goals) == 4 * 3


def test_equal_texts_are_judged_once(spark, monkeypatch):
    """Two ids say the same contract, a third another: two texts under two contracts are four goals, before twelve."""
    goals, judge = [], registry_validation.judge_parts
    monkeypatch.setattr(registry_validation, "judge_parts", lambda g, r: goals.append(g.count()) or judge(g, r))
    contracts = spark.createDataFrame([("a", '{"maximum":1}'), ("b", '{"maximum":1}'), ("c", '{"maximum":5}')], "id string, schema_json string")
    records = spark.createDataFrame([(i, t) for i in "aabbccd" for t in ("1", "3", "{", None)], "id string, t string")
    got = registry_validation.judge_records(records, contracts, ["id"], "t").collect()
    assert sorted((r.id, r.t or "", r.valid) for r in got) == sorted((i, t, None if i == "d" else t in ("1", "3") and int(t) <= {"c": 5}.get(i, 1)) for i in "aabbccd" for t in ("1", "3", "{", ""))
    assert goals == [4]


def test_undecided_parts_beside_failing_ones(spark):
    """What can't be decided counts only where type and enumeration hold; bounds that aren't there hold for any number."""
    said = ['{"type":"string","pattern":"(a|b)"}', '{"type":"string","pattern":"(a|b)","minLength":3}', '{"minimum":0}', '{"type":"object","patternProperties":{"(a|b)":{"type":"null"}},"additionalProperties":{"type":"integer"}}', '{"properties":{"x":{"type":"integer"}},"patternProperties":{"^x":{"minimum":3}},"additionalProperties":{"type":"null"},"propertyNames":{"maxLength":2}}']
    contracts = spark.createDataFrame(list(enumerate(said)), "c int, schema_json string")
    want = [(0, '"a"', None), (0, "1", False), (1, '"a"', False), (1, '"abc"', None), (2, "-1", False), (2, "1e30", True), (2, '"x"', True), (3, "{}", True), (3, '{"k":1}', None), (3, "[]", False)]
    want += [(4, '{"x":3}', True), (4, '{"x":2}', False), (4, '{"x":3.5}', False), (4, '{"xy":4,"z":null}', True), (4, '{"z":1}', False), (4, '{"xyz":4}', False)]
    records = spark.createDataFrame(want, "c int, t string, want boolean")
    got = registry_validation.judge_records(records, contracts, ["c"], "t").collect()
    assert [(r.c, r.t, r.want, r.valid) for r in got if r.valid != r.want] == [] and len(got) == len(want)


def test_equal_data_of_envelopes_is_judged_once(spark, monkeypatch):
    """Three ids whose versions say the same, and envelopes that differ around equal data: one goal, before six."""
    goals, judge = [], registry_validation.judge_parts
    monkeypatch.setattr(registry_validation, "judge_parts", lambda g, r: goals.append(g.count()) or judge(g, r))
    history = spark.createDataFrame([(i, v, '{"type":"integer"}') for i in "abc" for v in (1, 2)], "stable_id string, version int, schema_json string")
    records = spark.createDataFrame([(i, t) for i in "abc" for t in ('{"version":1,"data":7}', '{"data":7,"version":2}', '{"version":3,"data":7}')], "stable_id string, e string")
    got = registry_validation.read_registered(records, history, "e").collect()
    assert sorted((r.stable_id, r.version, r.valid) for r in got) == [(i, v, v < 3) for i in "abc" for v in (1, 2, 3)] and goals == [1]


def test_plain_parts_are_judged_with_what_leads_to_them(spark, monkeypatch):
    """Goals about scalars whose node leads nowhere are no rows of their own: one level here, before two; the verdicts are
    those of goals judged level by level."""
    said = ['{"properties":{"x":{"type":"integer","minimum":3},"y":{"pattern":"(a|b)"}},"required":["x"]}', '{"properties":{"x":{"anyOf":[{"type":"string"},{"minimum":3},{"pattern":"(a|b)"}]}}}', '{"contains":{"type":"integer"},"maxContains":1}', '{"not":{"maximum":2}}', '{"oneOf":[{"type":"integer"},{"minimum":3},{"properties":{"x":{}}}]}', '{"properties":{"x":{"$ref":"#/$defs/a"}},"$defs":{"a":{"not":{"const":4}}}}']
    texts = ['{"x":4,"y":"a"}', '{"x":4}', '{"x":2}', '{"x":2,"y":"a"}', '{"x":"a"}', "[1,[2]]", "[1,2]", "[[1]]", "1", "3", "4.5", '"a"', "null", "{}"]
    contracts, records = spark.createDataFrame(list(enumerate(said)), "c int, schema_json string"), spark.createDataFrame([(i, t) for i in range(len(said)) for t in texts], "c int, t string")
    levels, settle = [], registry_validation.settle
    monkeypatch.setattr(registry_validation, "settle", lambda df: levels.append("passed" in df.columns) or settle(df))
    judged = lambda c: {(r.c, r.t): r.valid for r in registry_validation.judge_records(records.filter(c), contracts, ["c"], "t").collect()}
    plain = judged("c = 0")
    assert sum(levels) == 1 and [plain[0, t] for t in texts] == [None, True, False, False, False, True, True, True, True, True, True, True, True, False]
    got = judged("true")
    monkeypatch.setattr(registry_validation, "NEAR", 0)
    assert got == judged("true") and len(got) == len(said) * len(texts)
    assert [got[1, t] for t in texts[1:5]] == [True] * 4 and [got[2, t] for t in texts[5:8]] == [True, False, False] and [got[4, t] for t in ("1", "3", '"a"', "{}")] == [False, False, False, False]


def test_values_for_contracts_said_more_than_once(spark, monkeypatch):
    """Three ids say the same contract of properties, one another, one none: two contracts' rules, before four and a
    duplicate map key; two ids of equal contracts have equal values."""
    counts, made = [], registry_generation.candidate_values
    monkeypatch.setattr(registry_generation, "candidate_values", lambda r, *a, **k: counts.append(r.count()) or made(r, *a, **k))
    text = lambda hi: '{"type":"object","properties":{"k":{"enum":["a","b"]},"v":{"type":"integer","maximum":%d}},"oneOf":[{"required":["k"]},{"required":["v"]}]}' % hi
    reg = spark.createDataFrame([*((i, text(5)) for i in "abc"), ("d", text(6)), ("e", None), ("f", None), ("g", "{"), ("h", "{")], "id string, schema_json string")
    got = {r.id: r for r in registry_generation.generate_registered(reg, ["id"], attempts=(8, 16)).collect()}
    assert counts[0] == 10 and {i: r.status for i, r in got.items()} == {i: "found" if i in "abcd" else "exhausted" for i in "abcdefgh"}
    assert all(len(json.loads(got[i].value).keys() & {"k", "v"}) == 1 for i in "abcd") and len({(got[i].value, got[i].tried) for i in "abc"}) == 1
