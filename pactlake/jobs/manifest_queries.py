"""Queries that write files and read them back, updates of manifests in place, parameters listed twice, and values for
patterns. Files go to new paths in the folder of spark.checkpoint.dir."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlake.functions.pattern_text import pattern_text
from pactlake.functions.settled import checkpoint_folder, settle
from pactlake.operators import generate, openapi, registry_generation, registry_scan, stamping
from pactlake.sources import files

from .codec_queries import VERSIONS as API_VERSIONS
from .codec_queries import api_pairs, event_texts
from .registry_queries import _REG, c2_grades, observed_registry
from .registry_queries import ORACLE_SQL as REGISTRY_SQL
from .validation_queries import table


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def s2_records(spark, sf_dir):
    """Event texts, some of them broken, as a file of lines and back."""
    at = _fresh(spark, "records")
    files.write_values(event_texts(spark, sf_dir), "text", at)
    good, bad = files.read_records(spark, at)
    user = F.sum(F.try_variant_get("doc", "$.user_id", "long"))
    return good.agg(F.lit("parsed").alias("side"), F.count("*").alias("n"), user.alias("users")).unionByName(bad.agg(F.lit("broken").alias("side"), F.count("*").alias("n"), F.sum(F.get_json_object("value", "$.gone").cast("long")).alias("users")))


def s3_manifest(spark, sf_dir):
    """The observed contracts as a manifest file and back, then checked: every eighth id has no versions, every tenth hashes
    that don't match, every 14th contracts with a keyword that none may have."""
    reg = observed_registry(spark, sf_dir).withColumn("stable_id", F.col("stable_id").cast("string"))
    k = F.col("stable_id").cast("long")
    text = F.when(k % 14 == 3, F.concat(F.lit('{"$anchor":"x",'), F.substr("schema_json", F.lit(2)))).otherwise(F.col("schema_json"))
    full = reg.filter(k % 8 != 0).withColumn("schema_json", text).withColumn("schema_sha256", F.when(k % 10 == 0, "sha256:0").otherwise(registry_scan.canonical_hash(F.col("schema_json"))))
    bare = reg.filter(k % 8 == 0).select("stable_id", F.lit(None).cast("int").alias("version"), F.lit(None).cast("string").alias("schema_json"), F.lit(None).cast("string").alias("schema_sha256")).distinct()
    at = _fresh(spark, "manifest")
    files.write_manifest(full.unionByName(bare), at)
    return stamping.manifest_errors(files.read_manifest(spark, at)).select("stable_id", "version", "error")


def s5_grades(spark, sf_dir):
    at = _fresh(spark, "grades")
    files.write_grades(c2_grades(spark, sf_dir), at)
    return spark.read.schema("id string, mode string, status string").json(at)


def reworded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(history, candidates): the contracts of the first three weeks, where every 13th id has none, and for each id its
    latest contract of those weeks again: as it is, with a title, with a property that takes anything, or with another
    bound, by the user's number."""
    reg = observed_registry(spark, sf_dir).filter("version < 4").withColumn("schema_sha256", registry_scan.canonical_hash(F.col("schema_json")))
    k, text = F.col("stable_id") % 4, F.col("schema_json")
    said = F.when(k == 0, text).when(k == 1, F.concat(F.substr(text, F.lit(1), F.length(text) - 1), F.lit(',"title":"t"}'))).when(k == 2, F.replace(text, F.lit('{"properties":{'), F.lit('{"properties":{"note":{},'))).otherwise(F.regexp_replace(text, '"maximum":', '"maximum":9'))
    return reg.filter("stable_id % 13 <> 0"), stamping.latest_version(reg).select("stable_id", said.alias("schema_json"))


def t3_updates(spark, sf_dir):
    return stamping.stamp_batch(*reworded(spark, sf_dir)).select("stable_id", "status", "version")


def t4_replaced(spark, sf_dir):
    """The manifest after the batch: versions an id has, the latest one, and whether it is the candidate."""
    old, new = reworded(spark, sf_dir)
    after = stamping.next_manifest(old, settle(stamping.stamp_batch(old, new)))
    counts = after.groupBy("stable_id").agg(F.count("*").alias("versions"))
    last = stamping.latest_version(after).join(new.withColumnRenamed("schema_json", "_new"), "stable_id")
    return counts.join(last, "stable_id").select("stable_id", "versions", F.col("version").alias("latest"), (F.col("schema_json") == F.col("_new")).alias("taken"))


def o2_duplicates(spark, sf_dir):
    """Descriptions where the operation refers to its query parameter twice, the path names its own in a header of two
    spellings, or neither, by the page's number."""
    k = F.col("page_id") % 3
    ref = '{"$ref":"#/components/parameters/P"}'
    doc = F.when(k == 0, F.replace("doc_json", F.lit(ref), F.lit(ref + ',{"in":"query","name":"q"}'))).when(k == 1, F.replace("doc_json", F.lit('"/a/{id}":{"parameters":['), F.lit('"/a/{id}":{"parameters":[{"in":"header","name":"X-A"},{"in":"header","name":"x-a"},{"in":"header","name":"Accept"},{"in":"header","name":"accept"},'))).otherwise(F.col("doc_json"))
    return openapi.duplicate_parameters(api_pairs(spark, sf_dir, "new").withColumn("doc_json", doc), ["page_id"])


def o16_duplicates(spark, sf_dir):
    """Two descriptions of an operation that are equal, but every second one lists a parameter twice."""
    pages = table(spark, sf_dir, "pages").filter(F.contains("url", F.lit("://"))).select("page_id")
    one = '{"in":"query","name":"q","schema":{"type":"string"}}'
    text = lambda many: F.concat(F.lit('{"openapi":"3.1.0","paths":{"/p":{"get":{"parameters":['), many, F.lit(f"],{API_VERSIONS[0][0]}" + "}}}}"))
    old = pages.select("page_id", text(F.lit(one)).alias("doc_json"))
    new = pages.select("page_id", text(F.when(F.col("page_id") % 2 == 0, f"{one},{one}").otherwise(one)).alias("doc_json"))
    return openapi.report(old, new, ["page_id"]).select("page_id", F.array_join("issues", ";").alias("issues"), "n", "is_compatible")


#: Patterns, and the bounds of length that texts for them must keep.
PATTERNS = [
    ("^[A-Z]{2}-\\d{3,6}$", 0, 40), ("^(?:ab|cde){2,9}x?$", 11, 14), ("^[a-z]+@(?:[a-z]+\\.)+(?:com|org)$", 0, 40), ("^(?=.*\\d)[a-z0-9]{8,}$", 0, 30), ("colou?r", 12, 12), ("^[^a-z\\s]{3}\\.\\w*$", 7, 40), ("^(\\d{4})-(0[1-9]|1[0-2])$", 0, 40), ("^a|z$", 3, 9),
]


def g5_patterns(spark, sf_dir):
    """For each customer a text for one of the patterns, judged without the library."""
    forms = F.array(*(F.struct(F.lit(p).alias("pattern"), F.lit(least).alias("least"), F.lit(most).alias("most")) for p, least, most in PATTERNS))
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % len(PATTERNS)).cast("int").alias("form")).withColumn("f", F.get(forms, F.col("form")))
    made = rows.select("form", "f", pattern_text("f.pattern", "f.least", "f.most", generate.uniform(42, "#", F.col("c_custkey"))).alias("text"))
    right = F.regexp_like("text", F.col("f.pattern")) & F.char_length("text").between(F.col("f.least"), F.col("f.most"))
    return made.groupBy("form").agg(F.count("*").alias("n"), F.count_if(right).alias("right"))


def g5_registered(spark, sf_dir):
    """A text for each observed contract's pattern: as many letters as there are kinds of events, or more, then digits;
    every seventh must be shorter than that, so has none."""
    k = F.size(F.try_variant_get(F.parse_json("schema_json"), "$.properties.event_type.enum", "array<string>")) + 9
    reg = observed_registry(spark, sf_dir).withColumn("k", k)
    reg = reg.withColumn("most", F.when(F.col("stable_id") % 7 == 0, F.col("k")).otherwise(F.col("k") + 6))
    reg = settle(reg.select("stable_id", "version", "k", "most", F.format_string('{"maxLength":%d,"pattern":"^[a-z]{%d,}_[0-9]+$","type":"string"}', "most", "k").alias("schema_json")))
    made = registry_generation.generate_registered(reg, ["stable_id", "version"], attempts=(4, 8)).join(reg.drop("schema_json"), ["stable_id", "version"])
    text = F.try_variant_get(F.try_parse_json("value"), "$", "string")
    right = F.coalesce(F.regexp_like(text, F.lit("^[a-z]+_[0-9]+$")) & (F.instr(text, "_") > F.col("k")) & (F.char_length(text) <= F.col("most")), F.lit(False))
    return made.select("stable_id", "version", "status", right.alias("right"), "tried")


QUERIES = {
    "S2_S4_records": s2_records, "S3_manifest": s3_manifest, "S5_grades": s5_grades, "T3_compatible_updates": t3_updates, "T4_replaced_versions": t4_replaced, "O2_duplicate_parameters": o2_duplicates, "O16_listed_twice": o16_duplicates,
    "G5_patterns": g5_patterns, "G5_registered_patterns": g5_registered,
}
_URL = "FROM pages WHERE strpos(url, '://') > 0"
_NEWEST = "l AS (SELECT stable_id, max(version) AS v, count(*) AS c, stable_id % 4 AS k, stable_id % 13 = 0 AS fresh FROM reg WHERE version < 4 GROUP BY 1)"
ORACLE_SQL = {
    "S2_S4_records": "SELECT CASE WHEN event_id % 17 = 0 THEN 'broken' ELSE 'parsed' END AS side, count(*) AS n, CAST(sum(user_id) FILTER (WHERE event_id % 17 <> 0) AS BIGINT) AS users FROM events GROUP BY 1",
    "S3_manifest": f"""WITH {_REG} SELECT DISTINCT CAST(stable_id AS VARCHAR) AS stable_id, CAST(NULL AS INTEGER) AS version, 'no versions' AS error FROM reg WHERE stable_id % 8 = 0
        UNION ALL SELECT CAST(stable_id AS VARCHAR), version, 'hash does not match' FROM reg WHERE stable_id % 8 <> 0 AND stable_id % 10 = 0 UNION ALL SELECT CAST(stable_id AS VARCHAR), version, 'contract is not valid' FROM reg WHERE stable_id % 8 <> 0 AND stable_id % 14 = 3""",
    "S5_grades": REGISTRY_SQL["C2_grades"],
    "T3_compatible_updates": f"WITH {_REG}, {_NEWEST} SELECT stable_id, CASE WHEN fresh THEN 'new' WHEN k = 0 THEN 'unchanged' WHEN k = 3 THEN 'breaking_change' ELSE 'compatible_update' END AS status, CAST(CASE WHEN fresh THEN 1 WHEN k = 3 THEN v + 1 ELSE v END AS INTEGER) AS version FROM l",
    "T4_replaced_versions": f"WITH {_REG}, {_NEWEST} SELECT stable_id, CASE WHEN fresh THEN 1 WHEN k = 3 THEN c + 1 ELSE c END AS versions, CAST(CASE WHEN fresh THEN 1 WHEN k = 3 THEN v + 1 ELSE v END AS INTEGER) AS latest, true AS taken FROM l",
    "O2_duplicate_parameters": f"""SELECT page_id, '/a/{{id}}' AS path, 'POST' AS method, 'operation' AS level, 'query' AS location, 'q' AS name, 2::BIGINT AS n {_URL} AND page_id % 3 = 0
        UNION ALL SELECT page_id, '/a/{{id}}', m, 'path', 'header', 'x-a', 2 FROM (SELECT page_id, unnest(CASE page_id % 9 WHEN 0 THEN ['POST'] ELSE ['POST', 'GET'] END) AS m {_URL} AND page_id % 3 = 1)""",
    "O16_listed_twice": f"SELECT page_id, CASE page_id % 2 WHEN 0 THEN 'GET /p request query: lists twice q' ELSE '' END AS issues, CAST(1 - page_id % 2 AS INTEGER) AS n, page_id % 2 = 1 AS is_compatible {_URL}",
    "G5_patterns": f"SELECT CAST(c_custkey % {len(PATTERNS)} AS INTEGER) AS form, count(*) AS n, count(*) AS right FROM customer GROUP BY 1",
    "G5_registered_patterns": f"WITH {_REG} SELECT stable_id, version, CASE stable_id % 7 WHEN 0 THEN 'exhausted' ELSE 'found' END AS status, stable_id % 7 <> 0 AS right, CASE stable_id % 7 WHEN 0 THEN 12 ELSE 1 END AS tried FROM reg",
}
