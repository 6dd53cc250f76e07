"""Queries where every record has a contract of its own, from a registry that Spark derives from the events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlake.operators import registry_generation, registry_validation

from .registry_queries import _ID, _PAIRS, _REG, EXAMPLES_SQL, c2_grades, golden_versions, observed_registry, pairs_of
from .validation_queries import table

SHAPES = 10


def week(ts: str = "ts") -> Column:
    return (F.floor(F.datediff(F.to_date(ts), F.lit("2024-01-01").cast("date")) / 7) + 1).cast("int")


def shaped_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observed registry, each contract said in one of ten ways, by the user's number: plainly, by a reference, in
    parts, by alternatives, by constants of which one holds, negated, conditionally, by a pattern of names, with an array,
    by dependent schemas. The ways mean the same for the records of event_records."""
    v = F.parse_json("schema_json")
    kinds = F.try_variant_get(v, "$.properties.event_type.enum", "array<string>")
    lo, hi = (F.try_variant_get(v, f"$.properties.value.{k}", "long") for k in ("minimum", "maximum"))
    quoted = F.to_json(kinds)
    required = F.to_json(F.try_variant_get(v, "$.required", "array<string>"))
    kind = F.concat(F.lit('"event_type":{"enum":'), quoted, F.lit("}"))
    bounds = F.format_string('"maximum":%d,"minimum":%d', hi, lo)
    value = F.concat(F.lit('"value":{'), bounds, F.lit(',"type":"number"}'))
    need = F.concat(F.lit('"required":'), required)
    middle = F.floor((lo + hi) / 2)
    one = F.array_join(F.transform(kinds, lambda k: F.concat(F.lit('{"properties":{"event_type":{"const":"'), k, F.lit('"}},"required":["event_type"]}'))), ",")
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    ways = F.array(
        text('{"properties":{', kind, ",", value, "},", need, "}"),
        text('{"$defs":{"a/b":{', bounds, '}},"properties":{', kind, ',"value":{"$ref":"#/$defs/a~1b","type":"number"}},', need, "}"),
        text('{"allOf":[{"properties":{', kind, '}},{"properties":{', value, "},", need, "}]}"),
        text('{"properties":{', kind, ',"value":{"anyOf":[', F.format_string('{"minimum":%d,"maximum":%d,"type":"number"},{"minimum":%d,"maximum":%d,"type":"number"}', lo, middle, middle, hi), "]}},", need, "}"),
        text('{"oneOf":[', one, '],"properties":{', value, "},", need, "}"),
        text('{"properties":{', kind, ',"value":{"type":"number","not":{"anyOf":[', F.format_string('{"exclusiveMaximum":%d},{"exclusiveMinimum":%d}', lo, hi), "]}}},", need, "}"),
        text('{"if":{"properties":{', kind, '},"required":["event_type"]},"then":{"properties":{', value, "},", need, '},"else":false}'),
        text('{"properties":{', kind, '},"patternProperties":{"^val":{', bounds, '}},"propertyNames":{"enum":["event_type","value","tags"]},', need, "}"),
        text('{"properties":{', kind, ",", value, ',"tags":{"prefixItems":[{"enum":', quoted, '}],"items":{"type":"integer"},"contains":{"type":"integer"},"minItems":2,"uniqueItems":true}},', need, "}"),
        text('{"dependentSchemas":{"event_type":{"properties":{', kind, '}}},"properties":{', value, "},", need, "}"),
    )
    return observed_registry(spark, sf_dir).select(*_ID, F.concat(F.lit('{"type":"object",'), F.substr(F.get(ways, (F.col("stable_id") % SHAPES).cast("int")), F.lit(2))).alias("schema_json"), kinds.alias("kinds"), lo.alias("lo"), hi.alias("hi"))


def event_records(spark: SparkSession, sf_dir: str, more: Column | None = None) -> DataFrame:
    """(event_id, stable_id, event_type, week, doc): JSON texts; every fifth without a value, every 17th broken; more: what
    follows, by default an array of tags."""
    e = table(spark, sf_dir, "events").filter("user_id IS NOT NULL")
    value = F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat(F.lit(',"value":'), F.col("value").cast("string")))
    tags = F.concat(F.lit(',"tags":["'), "event_type", F.lit('",'), (F.col("event_id") % 100).cast("string"), F.lit("]"))
    end = F.when(F.col("event_id") % 17 == 0, "").otherwise("}")
    return e.select("event_id", F.col("user_id").alias("stable_id"), "event_type", week().alias("week"), F.concat(F.lit('{"event_type":"'), "event_type", F.lit('"'), value, tags if more is None else more, end).alias("doc"))


def t8_registered(spark, sf_dir):
    """Events wrapped by the latest contract of their user, by the way it is said and its version."""
    stamped = registry_validation.stamp_registered(event_records(spark, sf_dir), shaped_registry(spark, sf_dir), "doc")
    return stamped.groupBy((F.col("stable_id") % SHAPES).alias("shape"), "event_type", F.get_json_object("envelope", "$.version").cast("int").alias("version")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes of this week's version or one of the two before; every 19th with another key, every 23rd with a version
    that is a text."""
    version = (F.col("week") - F.col("event_id") % 3).cast("string")
    version = F.when(F.col("event_id") % 23 == 0, F.concat(F.lit('"'), version, F.lit('"'))).otherwise(version)
    more = F.when(F.col("event_id") % 19 == 0, ',"more":1').otherwise("")
    return event_records(spark, sf_dir).withColumn("envelope", F.concat(F.lit('{"version":'), version, F.lit(',"data":'), "doc", more, F.lit("}"))).drop("doc", "week")


def t9_registered(spark, sf_dir):
    read = registry_validation.read_registered(envelopes(spark, sf_dir), shaped_registry(spark, sf_dir), "envelope")
    return read.groupBy((F.col("stable_id") % SHAPES).alias("shape"), "event_type", "valid").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def r37_registered(spark, sf_dir):
    """For each pair of a user's contracts: the user's events that one side takes and the other doesn't. Every fourth event
    has a key that no contract declares."""
    records = event_records(spark, sf_dir, F.when(F.col("event_id") % 4 == 0, ',"extra":1').otherwise(""))
    pairs = pairs_of(observed_registry(spark, sf_dir))
    return registry_validation.data_compat_registered(records, pairs, "stable_id", "doc", _ID)


def _accepts(doc: Column, kinds: Column, lo: Column, hi: Column) -> Column:
    """Whether an observed contract takes a text, by its parts and without the library's judgement."""
    v = F.try_parse_json(doc)
    value = F.try_variant_get(v, "$.value", "double")
    kind = F.coalesce(F.array_contains(kinds, F.try_variant_get(v, "$.event_type", "string")), F.lit(False))
    return kind & F.when(value.isNull(), ~F.array_contains(kinds, "purchase")).otherwise((value >= lo) & (value <= hi))


def _parts(df: DataFrame, text: str, prefix: str) -> DataFrame:
    v = F.parse_json(text)
    return df.withColumns({f"{prefix}_kinds": F.try_variant_get(v, "$.properties.event_type.enum", "array<string>"), f"{prefix}_lo": F.try_variant_get(v, "$.properties.value.minimum", "long"), f"{prefix}_hi": F.try_variant_get(v, "$.properties.value.maximum", "long")})


def g9_registered(spark, sf_dir):
    """A value for each contract, and whether it is one by the contract's parts."""
    reg = shaped_registry(spark, sf_dir)
    made = registry_generation.generate_registered(reg, _ID).join(reg.drop("schema_json"), _ID)
    return made.groupBy((F.col("stable_id") % SHAPES).alias("shape"), "status", _accepts(F.col("value"), F.col("kinds"), F.col("lo"), F.col("hi")).alias("right")).agg(F.count("*").alias("n"))


def _shown(df: DataFrame, witness: str) -> DataFrame:
    df = _parts(_parts(df, "old", "o"), "new", "n")
    old, new = (_accepts(F.col(witness), F.col(f"{p}_kinds"), F.col(f"{p}_lo"), F.col(f"{p}_hi")) for p in "on")
    return df.withColumn("shown", F.coalesce(F.when(F.col("direction") == "serializer", new & ~old).otherwise(old & ~new), F.lit(False)))


def g10_counterexamples(spark, sf_dir):
    """For each direction of consecutive contracts in which they are incompatible: a value that shows it."""
    pairs = pairs_of(observed_registry(spark, sf_dir))
    found = registry_generation.counterexamples(pairs, _ID)
    return _shown(found.join(pairs, _ID), "witness").select(*_ID, "direction", "shown")


def c4_examples(spark, sf_dir):
    """For incompatible entries of two golden tables, whose old mode is serializer: whether the example shows it."""
    old, new = golden_versions(spark, sf_dir)
    shown = registry_generation.grade_examples(c2_grades(spark, sf_dir), old, new).filter("status = 'incompatible'")
    texts = old.select("id", F.col("schema_json").alias("old")).join(new.select("id", F.col("schema_json").alias("new")), "id")
    return _shown(shown.join(texts, "id").withColumn("direction", F.lit("serializer")), "example").select("id", "shown")


QUERIES = {"T8_registered_records": t8_registered, "T9_registered_envelopes": t9_registered, "R37_registered_records": r37_registered, "G9_registered_values": g9_registered, "G10_counterexamples": g10_counterexamples, "C4_examples": c4_examples}
_E = "e AS (SELECT event_id, user_id AS stable_id, event_type, CAST(floor(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 7.0) AS INTEGER) + 1 AS week, CASE WHEN event_id % 5 <> 0 THEN value END AS value FROM events WHERE user_id IS NOT NULL)"
_OK = lambda p: f"coalesce(event_id % 17 <> 0 AND list_contains({p}.kinds, event_type) AND CASE WHEN value IS NULL THEN NOT list_contains({p}.kinds, 'purchase') ELSE value BETWEEN {p}.lo AND {p}.hi END, false)"
ORACLE_SQL = {
    "T8_registered_records": f"WITH {_REG}, {_E}, l AS (SELECT stable_id, max(version) AS version, arg_max(kinds, version) AS kinds, arg_max(lo, version) AS lo, arg_max(hi, version) AS hi FROM reg GROUP BY 1) SELECT stable_id % {SHAPES} AS shape, event_type, version, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM e JOIN l USING (stable_id) WHERE {_OK('l')} GROUP BY ALL",
    "T9_registered_envelopes": f"WITH {_REG}, {_E} SELECT e.stable_id % {SHAPES} AS shape, event_type, event_id % 19 <> 0 AND event_id % 23 <> 0 AND {_OK('r')} AS valid, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM e LEFT JOIN reg r ON r.stable_id = e.stable_id AND r.version = week - event_id % 3 GROUP BY ALL",
    "R37_registered_records": f"""{_PAIRS}, {_E}, old AS (SELECT stable_id, version, 'serializer' AS direction, lo, hi, kinds, olo, ohi, okinds FROM pairs UNION ALL SELECT stable_id, version, 'deserializer', olo, ohi, okinds, lo, hi, kinds FROM pairs),
        s AS (SELECT stable_id, version, direction, {{'lo': lo, 'hi': hi, 'kinds': kinds}} AS src, {{'lo': olo, 'hi': ohi, 'kinds': okinds}} AS dst FROM old)
        SELECT stable_id, version, direction, count(*) FILTER (WHERE {_OK('src')} AND (direction = 'serializer' OR event_id % 4 <> 0)) AS seen, count(*) FILTER (WHERE {_OK('src')} AND (direction = 'serializer' OR event_id % 4 <> 0) AND NOT {_OK('dst')}) AS witnesses FROM s JOIN e USING (stable_id) GROUP BY ALL""",
    "G9_registered_values": f"WITH {_REG} SELECT stable_id % {SHAPES} AS shape, 'found' AS status, true AS right, count(*) AS n FROM reg GROUP BY ALL",
    "G10_counterexamples": f"{_PAIRS} SELECT stable_id, version, direction, true AS shown FROM broken WHERE why IS NOT NULL",
    "C4_examples": EXAMPLES_SQL,
}
