"""Queries over registries that Spark derives from the driver tables: per user and week, a contract observed from
that week's events. The registry grows with the users and the weeks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlake.operators import compat, registry_scan, stamping

from .validation_queries import VERSIONS, event_documents, table

_ID = ["stable_id", "version"]


def observed_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stable_id, version, schema_json) from events; key-sorted compact JSON."""
    e = table(spark, sf_dir, "events").filter("user_id IS NOT NULL")
    week = (F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 7) + 1).cast("int")
    per = e.groupBy(F.col("user_id").alias("stable_id"), week.alias("version")).agg(F.floor(F.min("value")).alias("lo"), F.ceil(F.max("value")).alias("hi"), F.array_sort(F.collect_set("event_type")).alias("kinds"))
    enum = F.array_join(F.transform("kinds", lambda k: F.concat(F.lit('"'), k, F.lit('"'))), ",")
    paid = F.when(F.array_contains("kinds", "purchase"), F.lit('"event_type","value"')).otherwise(F.lit('"event_type"'))
    text = F.format_string('{"properties":{"event_type":{"enum":[%s],"type":"string"},"value":{"maximum":%d,"minimum":%d,"type":"number"}},"required":[%s],"type":"object"}', enum, "hi", "lo", paid)
    return per.select("stable_id", "version", text.alias("schema_json"))


_PER = "SELECT user_id AS stable_id, CAST(floor(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7.0) AS INTEGER) + 1 AS version, CAST(floor(min(value)) AS BIGINT) AS lo, CAST(ceil(max(value)) AS BIGINT) AS hi, list_sort(list_distinct(list(event_type))) AS kinds FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2"
_TEXT = """'{"properties":{"event_type":{"enum":[' || array_to_string(list_transform(kinds, lambda k: '"' || k || '"'), ',') || '],"type":"string"},"value":{"maximum":' || hi || ',"minimum":' || lo || ',"type":"number"}},"required":[' || CASE WHEN list_contains(kinds, 'purchase') THEN '"event_type","value"' ELSE '"event_type"' END || '],"type":"object"}'"""
_REG = f"reg AS (SELECT stable_id, version, lo, hi, kinds, {_TEXT} AS schema_json FROM ({_PER}))"
_PAIRS = f"""WITH {_REG}, pairs AS (SELECT * FROM (SELECT stable_id, version, lo, hi, kinds, schema_json, lag(lo) OVER w AS olo, lag(hi) OVER w AS ohi, lag(kinds) OVER w AS okinds, lag(schema_json) OVER w AS old_json FROM reg WINDOW w AS (PARTITION BY stable_id ORDER BY version)) WHERE old_json IS NOT NULL),
sides AS (SELECT stable_id, version, 'serializer' AS direction, lo AS blo, hi AS bhi, kinds AS bk, olo AS plo, ohi AS phi, okinds AS pk FROM pairs UNION ALL SELECT stable_id, version, 'deserializer', olo, ohi, okinds, lo, hi, kinds FROM pairs),
broken AS (SELECT stable_id, version, direction, CASE WHEN list_contains(pk, 'purchase') AND NOT list_contains(bk, 'purchase') THEN ['#', 'required'] WHEN len(list_filter(bk, lambda k: NOT list_contains(pk, k))) > 0 THEN ['#/properties/event_type', 'enum'] WHEN (blo < plo OR bhi > phi) AND (blo = bhi OR plo = phi) THEN ['#/properties/value', 'enum'] WHEN blo < plo THEN ['#/properties/value', 'minimum'] WHEN bhi > phi THEN ['#/properties/value', 'maximum'] END AS why, * EXCLUDE (stable_id, version, direction) FROM sides)"""


def pairs_of(reg: DataFrame) -> DataFrame:
    return compat.pair_versions(reg).withColumn("role", F.lit("both"))


def n1_nodes(spark, sf_dir):
    return registry_scan.schema_nodes(observed_registry(spark, sf_dir), _ID).groupBy("pointer").agg(F.count("*").alias("n"))


def n2_constraints(spark, sf_dir):
    return registry_scan.constraints(registry_scan.schema_nodes(observed_registry(spark, sf_dir), _ID), _ID).filter("keyword <> 'type'")


def n11_bounds(spark, sf_dir):
    nodes = registry_scan.node_table(registry_scan.schema_nodes(observed_registry(spark, sf_dir), _ID), _ID)
    return nodes.filter("n.lo IS NOT NULL").select(*_ID, "pointer", F.col("n.lo").cast("long").alias("lo"), F.col("n.hi").cast("long").alias("hi"))


def n13_implied(spark, sf_dir):
    nodes = registry_scan.node_table(registry_scan.schema_nodes(observed_registry(spark, sf_dir), _ID), _ID)
    return nodes.filter("pointer = '#'").groupBy(F.col("n.min_props").alias("min_props")).agg(F.count("*").alias("n"))


def n14_hash(spark, sf_dir):
    return observed_registry(spark, sf_dir).select(*_ID, registry_scan.canonical_hash(F.col("schema_json")).alias("schema_sha256"))


def n15_dedupe(spark, sf_dir):
    return registry_scan.dedupe_schemas(observed_registry(spark, sf_dir), "stable_id")


def r34_verdicts(spark, sf_dir):
    return compat.check_compat(pairs_of(observed_registry(spark, sf_dir)), _ID).select(*_ID, "direction", "verdict")


def r35_explain(spark, sf_dir):
    return compat.check_compat(pairs_of(observed_registry(spark, sf_dir)), _ID).filter("verdict <> 'compatible'").select(*_ID, "direction", "pointer", "keyword")


def r36_reasons(spark, sf_dir):
    return compat.check_compat(pairs_of(observed_registry(spark, sf_dir)), _ID).filter("verdict <> 'compatible'").select(*_ID, "direction", "message")


def _golden(reg: DataFrame, version: int) -> DataFrame:
    return reg.filter(F.col("version") == version).select(F.col("stable_id").cast("string").alias("id"), F.lit("serializer").alias("mode"), "schema_json", F.col("stable_id").cast("string").alias("stable_id"))


def golden_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The first and the second version as golden tables; every eleventh id lacks the second."""
    reg = observed_registry(spark, sf_dir)
    return _golden(reg, 1), _golden(reg.filter("stable_id % 11 <> 0"), 2)


def c2_grades(spark, sf_dir):
    return compat.grade(*golden_versions(spark, sf_dir))


def c5_gate(spark, sf_dir):
    grades = c2_grades(spark, sf_dir)
    return grades.groupBy("status").agg(F.count("*").alias("n"))


def t2_latest(spark, sf_dir):
    reg = observed_registry(spark, sf_dir).withColumn("schema_sha256", registry_scan.canonical_hash(F.col("schema_json")))
    return stamping.latest_version(reg).select("stable_id", "version", "schema_sha256")


def t3_stamp(spark, sf_dir):
    reg = observed_registry(spark, sf_dir).withColumn("schema_sha256", registry_scan.canonical_hash(F.col("schema_json")))
    return stamping.stamp_batch(reg.filter("version < 4 AND stable_id % 13 <> 0"), reg.filter("version = 4").select("stable_id", "schema_json")).select("stable_id", "status", "version")


def t4_manifest(spark, sf_dir):
    reg = observed_registry(spark, sf_dir).withColumn("schema_sha256", registry_scan.canonical_hash(F.col("schema_json")))
    old = reg.filter("version < 4 AND stable_id % 13 <> 0")
    stamped = stamping.stamp_batch(old, reg.filter("version = 4").select("stable_id", "schema_json"))
    return stamping.next_manifest(old, stamped).groupBy("stable_id").agg(F.count("*").alias("versions"), F.max("version").alias("latest"))


def stamped_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes of three versions: the version is the event's, by its id."""
    docs = event_documents(spark, sf_dir)
    parts = [stamping.stamp_records(docs.filter(F.col("event_id") % 3 == i), "doc", i + 1, VERSIONS[f"v{i + 1}"]) for i in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def t8_stamp_records(spark, sf_dir):
    return stamped_events(spark, sf_dir).groupBy((F.col("event_id") % 3 + 1).alias("version")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def t9_read_stamped(spark, sf_dir):
    """Read back by readers of versions 1 and 3 only, with version 2 judged as unknown."""
    read = stamping.read_stamped(stamped_events(spark, sf_dir), "envelope", {1: VERSIONS["v3"], 3: VERSIONS["v1"]})
    return read.groupBy("event_type", "version", "valid").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def t10_mix(spark, sf_dir):
    read = stamping.read_stamped(stamped_events(spark, sf_dir), "envelope", {i + 1: VERSIONS[f"v{i + 1}"] for i in range(3)})
    return stamping.version_mix(read, "event_type")


QUERIES = {
    "N1_schema_nodes": n1_nodes, "N2_constraints": n2_constraints, "N11_numeric_bounds": n11_bounds, "N13_implied_minimums": n13_implied, "N14_canonical_hash": n14_hash, "N15_dedupe_schemas": n15_dedupe,
    "R34_verdicts": r34_verdicts, "R35_explain": r35_explain, "R36_reasons": r36_reasons, "C2_grades": c2_grades, "C5_gate": c5_gate,
    "T2_latest_version": t2_latest, "T3_stamp_batch": t3_stamp, "T4_next_manifest": t4_manifest, "T8_stamp_records": t8_stamp_records, "T9_read_stamped": t9_read_stamped, "T10_version_mix": t10_mix,
}
_K = "CAST(json_extract(props, '$.k') AS BIGINT)"
_V = f"CASE event_id % 3 WHEN 0 THEN {_K} <= 99 WHEN 1 THEN {_K} <= 49 ELSE {_K} <= 49 AND {_K} % 7 = 0 AND value >= 20 END"
_WITHIN = "lo >= plo AND hi <= phi AND len(list_filter(kinds, lambda k: NOT list_contains(pk, k))) = 0 AND (NOT list_contains(pk, 'purchase') OR list_contains(kinds, 'purchase'))"
_STAMP = f"""WITH {_REG}, old AS (SELECT * FROM reg WHERE version < 4 AND stable_id % 13 <> 0), latest AS (SELECT stable_id, max(version) AS v, arg_max(schema_json, version) AS ps FROM old GROUP BY 1),
stamped AS (SELECT stable_id, CASE WHEN v IS NULL THEN 'new' WHEN ps = schema_json THEN 'unchanged' ELSE 'breaking_change' END AS status, CASE WHEN v IS NULL THEN 1 WHEN ps = schema_json THEN v ELSE v + 1 END AS version FROM reg LEFT JOIN latest USING (stable_id) WHERE version = 4)"""
ORACLE_SQL = {
    "N1_schema_nodes": f"WITH {_REG} SELECT unnest(['#', '#/properties/event_type', '#/properties/value']) AS pointer, count(*) AS n FROM reg GROUP BY 1",
    "N2_constraints": f"""WITH {_REG} SELECT stable_id, version, u.p AS pointer, u.k AS keyword, u.v AS value FROM (SELECT stable_id, version, unnest([
        {{'p': '#', 'k': 'required', 'v': CASE WHEN list_contains(kinds, 'purchase') THEN '["event_type","value"]' ELSE '["event_type"]' END}}, {{'p': '#/properties/event_type', 'k': 'enum', 'v': '["' || array_to_string(kinds, '","') || '"]'}},
        {{'p': '#/properties/value', 'k': 'minimum', 'v': CAST(lo AS VARCHAR)}}, {{'p': '#/properties/value', 'k': 'maximum', 'v': CAST(hi AS VARCHAR)}}]) AS u FROM reg)""",
    "N11_numeric_bounds": f"WITH {_REG} SELECT stable_id, version, '#/properties/value' AS pointer, lo, hi FROM reg",
    "N13_implied_minimums": f"WITH {_REG} SELECT CASE WHEN list_contains(kinds, 'purchase') THEN 2 ELSE 1 END::BIGINT AS min_props, count(*) AS n FROM reg GROUP BY 1",
    "N14_canonical_hash": f"WITH {_REG} SELECT stable_id, version, 'sha256:' || sha256(schema_json) AS schema_sha256 FROM reg",
    "N15_dedupe_schemas": f"WITH {_REG} SELECT 'sha256:' || sha256(schema_json) AS schema_sha256, count(*) AS n, min(stable_id) AS first_id FROM reg GROUP BY 1",
    "R34_verdicts": f"{_PAIRS} SELECT stable_id, version, direction, CASE WHEN why IS NULL THEN 'compatible' ELSE 'incompatible' END AS verdict FROM broken",
    "R35_explain": f"{_PAIRS} SELECT stable_id, version, direction, why[1] AS pointer, why[2] AS keyword FROM broken WHERE why IS NOT NULL",
    "R36_reasons": f"""{_PAIRS} SELECT stable_id, version, direction, CASE why[2] WHEN 'required' THEN 'property ''value'' is no longer guaranteed to be present'
        WHEN 'enum' THEN CASE WHEN why[1] LIKE '%event_type' THEN 'value "' || list_filter(bk, lambda k: NOT list_contains(pk, k))[1] || '" is no longer accepted' WHEN blo = bhi THEN 'value ' || blo || ' is no longer accepted' ELSE 'values beyond ' || plo || ' are possible' END
        ELSE 'bounds [' || blo || ', ' || bhi || '] not contained by required bounds [' || plo || ', ' || phi || ']' END AS message FROM broken WHERE why IS NOT NULL""",
    "C2_grades": f"""WITH {_REG}, o AS (SELECT * FROM reg WHERE version = 1), n AS (SELECT * FROM reg WHERE version = 2 AND stable_id % 11 <> 0), m AS (SELECT coalesce(n.stable_id, o.stable_id) AS id, o.schema_json AS oj, n.schema_json AS nj, n.lo, n.hi, n.kinds, o.lo AS plo, o.hi AS phi, o.kinds AS pk FROM o FULL JOIN n USING (stable_id))
        SELECT CAST(id AS VARCHAR) AS id, 'serializer' AS mode, CASE WHEN nj IS NULL THEN 'missing_new' WHEN oj IS NULL THEN 'missing_old' WHEN oj = nj THEN 'identical' WHEN {_WITHIN} THEN 'ok' ELSE 'incompatible' END AS status FROM m""",
    "T2_latest_version": f"WITH {_REG} SELECT stable_id, max(version) AS version, 'sha256:' || sha256(arg_max(schema_json, version)) AS schema_sha256 FROM reg GROUP BY 1",
    "T3_stamp_batch": f"{_STAMP} SELECT stable_id, status, version FROM stamped",
    "T4_next_manifest": f"{_STAMP} SELECT stable_id, count(*) AS versions, max(version) AS latest FROM (SELECT stable_id, version FROM old UNION SELECT stable_id, version FROM stamped) GROUP BY 1",
    "T8_stamp_records": f"SELECT event_id % 3 + 1 AS version, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE {_V} GROUP BY 1",
    "T9_read_stamped": f"SELECT event_type, CAST(event_id % 3 + 1 AS INTEGER) AS version, CASE event_id % 3 WHEN 0 THEN {_K} <= 49 AND {_K} % 7 = 0 AND value >= 20 WHEN 1 THEN false ELSE {_K} <= 99 END AS valid, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE {_V} GROUP BY ALL",
    "T10_version_mix": f"SELECT event_type, CAST(event_id % 3 + 1 AS INTEGER) AS version, true AS valid, count(*) AS n FROM events WHERE {_V} GROUP BY ALL",
}
#: Incompatible entries; registered_queries has their query.
EXAMPLES_SQL = f"""WITH {_REG}, m AS (SELECT n.stable_id, n.lo, n.hi, n.kinds, o.lo AS plo, o.hi AS phi, o.kinds AS pk FROM reg o JOIN reg n USING (stable_id) WHERE o.version = 1 AND n.version = 2 AND n.stable_id % 11 <> 0)
    SELECT CAST(stable_id AS VARCHAR) AS id, true AS shown FROM m WHERE NOT ({_WITHIN})"""
ORACLE_SQL["C5_gate"] = f"SELECT status, count(*) AS n FROM ({ORACLE_SQL['C2_grades']}) GROUP BY 1"
