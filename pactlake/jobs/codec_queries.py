"""Queries over the driver tables for typed decode, API descriptions, counterexamples and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactlake.functions.settled import checkpoint_folder
from pactlake.operators import codec, openapi
from pactlake.sources.files import split_json
from pactlake.streaming import streams

from .registry_queries import ORACLE_SQL as REGISTRY_SQL
from .registry_queries import stamped_events
from .validation_queries import EVENT, EVENT_SQL, table
from .validation_queries import VERSIONS as RECORD_VERSIONS

CONTRACT = {"type": "object", "required": ["event_type"], "properties": {"event_type": {"type": "string"}, "value": {"type": ["number", "null"]}, "user_id": {"type": "integer", "minimum": 0}}}


def event_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, text): JSON with value missing, null or there, an undeclared key, and every 17th text broken."""
    e = table(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 3 == 0, F.lit("")).when(F.col("event_id") % 3 == 1, F.lit(',"value":null')).otherwise(F.concat(F.lit(',"value":'), F.round("value").cast("long").cast("string")))
    text = F.concat(F.lit('{"event_type":"'), "event_type", F.lit('"'), value, F.lit(',"user_id":'), F.col("user_id").cast("string"), F.lit(',"props":'), "props", F.when(F.col("event_id") % 17 == 0, F.lit(',"user_id":1}')).otherwise(F.lit("}")))
    return e.select("event_id", text.alias("text"))


def d2_decode(spark, sf_dir):
    good, _ = codec.decode(event_texts(spark, sf_dir), "text", CONTRACT, ["event_id"])
    return good.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"), F.sum(F.try_variant_get("value", "$", "long")).alias("value"))


def d3_extras(spark, sf_dir):
    good, _ = codec.decode(event_texts(spark, sf_dir), "text", CONTRACT, ["event_id"])
    k = F.try_variant_get(codec.get_additional_property("props"), "$.k", "long")
    return good.groupBy(F.array_join(F.array_sort(F.map_keys("extra")), ",").alias("extra_keys")).agg(F.count("*").alias("n"), F.sum(k).alias("k"))


def d4_missing(spark, sf_dir):
    good, _ = codec.decode(event_texts(spark, sf_dir), "text", CONTRACT, ["event_id"])
    null = F.array_contains("present", "value") & F.coalesce(F.is_variant_null("value"), F.lit(True))
    return good.groupBy(codec.is_missing("value").alias("missing"), null.alias("is_null")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def d7_round_trip(spark, sf_dir):
    return codec.round_trip_audit(event_texts(spark, sf_dir), "text", CONTRACT, ["event_id"]).groupBy("same").agg(F.count("*").alias("n"))


def d8_tagged(spark, sf_dir):
    view, rest = T.StructType([T.StructField("user_id", T.LongType())]), T.StructType([T.StructField("event_type", T.StringType()), T.StructField("props", T.StructType([T.StructField("k", T.LongType())]))])
    u = codec.tagged_union(F.try_parse_json("text"), "event_type", {"view": view, "click": rest})
    rows = event_texts(spark, sf_dir).select(u.alias("u"))
    return rows.agg(F.count("u.view.user_id").alias("views"), F.sum("u.view.user_id").alias("users"), F.count("u.click.event_type").alias("clicks"), F.sum("u.click.props.k").alias("k"))


def d9_rejected(spark, sf_dir):
    good, bad = split_json(event_texts(spark, sf_dir), "text")
    return good.agg(F.lit("parsed").alias("side"), F.count("*").alias("n")).unionByName(bad.agg(F.lit("rejected").alias("side"), F.count("*").alias("n")))


def api_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(host, side, doc_json): per host, one description from even pages (old) and one from odd pages (new): the first
    path segment is a path, the page number picks the method."""
    p = table(spark, sf_dir, "pages")
    rest = F.regexp_extract("url", "://([^/?#]*)(/[^/?#]*)?", 0)
    host, path = F.regexp_extract("url", "://([^/?#]*)", 1), F.concat(F.regexp_extract("url", "://[^/?#]*(/[^/?#]*)", 1), F.lit("/{id}"))
    method = F.element_at(F.array(*map(F.lit, ("get", "post", "put"))), (F.col("page_id") % 3 + 1).cast("int"))
    rows = p.filter(rest != "").select(host.alias("host"), F.when(F.col("page_id") % 2 == 0, "old").otherwise("new").alias("side"), path.alias("path"), method.alias("method")).distinct()
    need = F.when((F.col("side") == "new") & (F.col("method") == "post"), "true").otherwise("false")
    op = F.format_string('{"parameters":[{"in":"header","name":"X-Trace","required":%s},{"in":"header","name":"Accept"}],"responses":{"2XX":{},"404":{},"default":{}}}', need)
    items = rows.groupBy("host", "side", "path").agg(F.map_from_entries(F.collect_list(F.struct("method", F.parse_json(op)))).alias("ops"))
    item = F.parse_json(F.concat(F.lit('{"parameters":[{"in":"path","name":"id","required":true}],'), F.substr(F.to_json("ops"), F.lit(2))))
    docs = items.groupBy("host", "side").agg(F.map_from_entries(F.collect_list(F.struct("path", item.alias("i")))).alias("paths"))
    return docs.select("host", "side", F.to_json(F.struct(F.lit("3.1.0").alias("openapi"), "paths")).alias("doc_json"))


_IDS = ["host", "side"]


def o1_operations(spark, sf_dir):
    docs = api_documents(spark, sf_dir)
    return openapi.operations(docs.filter(openapi.is_openapi()), _IDS).select(*_IDS, "path", "method")


def o2_parameters(spark, sf_dir):
    params = openapi.parameters(openapi.operations(api_documents(spark, sf_dir), _IDS), _IDS)
    return params.groupBy("side", "method", "location", "name", "required").agg(F.count("*").alias("n"))


def o5_templates(spark, sf_dir):
    """In every fourth description the path names its parameter otherwise."""
    docs = api_pairs(spark, sf_dir, "new").withColumn("doc_json", F.when(F.col("page_id") % 4 == 0, F.replace("doc_json", F.lit('"/a/{id}"'), F.lit('"/a/{key}"'))).otherwise(F.col("doc_json")))
    ops = openapi.operations(docs, ["page_id"])
    return openapi.template_mismatches(ops, openapi.parameters(ops, ["page_id"]), ["page_id"])


def o9_statuses(spark, sf_dir):
    return openapi.statuses(openapi.operations(api_documents(spark, sf_dir), _IDS), _IDS).groupBy("side", "entry").agg(F.count("*").alias("n"))


def _diff(spark, sf_dir):
    ops = openapi.operations(api_documents(spark, sf_dir), _IDS)
    both = [ops.filter(F.col("side") == s) for s in ("old", "new")]
    return ops, *both


def o14_removed(spark, sf_dir):
    _, old, new = _diff(spark, sf_dir)
    return openapi.removed_operations(old, new, ["host"])


def o15_changed(spark, sf_dir):
    _, old, new = _diff(spark, sf_dir)
    return openapi.changed_operations(old, new, ["host"]).select("host", "path", "method")


#: What changes between the two descriptions of a page, by its number: request schema, response schema, and so on; the
#: issue that follows, without method, path and surface, or None.
CHANGES = 9


def api_pairs(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """(page_id, doc_json): for each page with a url, an API description before or after the change of its number."""
    new = lambda k, yes, no: F.when((F.col("page_id") % CHANGES == k) & F.lit(side == "new"), yes).otherwise(no)
    text = F.format_string(
        '{"openapi":"3.1.0","components":{"schemas":{"S":{"type":"integer","minimum":%d}},"parameters":{"P":{"in":"query","name":"q","required":%s,"schema":{"type":"string"}%s}},"requestBodies":{"B":{"required":%s,"content":{"application/json":{"schema":{"type":"object","properties":{"v":{"$ref":"#/components/schemas/S"}}}}%s}}}},'
        '"paths":{"/a/{id}":{"parameters":[{"in":"path","name":"id","required":true,"schema":{"enum":[%s]}}],"post":{"parameters":[{"$ref":"#/components/parameters/P"}],"requestBody":{"$ref":"#/components/requestBodies/B"},"responses":{"200":{"headers":{"X-Id":{"required":true,"schema":{"type":"string","maxLength":%d}}},"content":{"application/json":{"schema":{"type":%s}}}}}}%s}}}',
        new(1, 5, 3), new(2, "true", "false"), new(3, ',"style":"pipeDelimited"', ""), new(4, "true", "false"), new(5, "", ',"text/*":{},"text/plain":{}'), new(6, '"x"', '"x","y"'), new(7, 9, 8), new(8, '["object","null"]', '"object"'), new(0, "", ',"get":{"responses":{}}'),
    )
    return table(spark, sf_dir, "pages").filter(F.contains("url", F.lit("://"))).select("page_id", text.alias("doc_json"))


def _changed(spark, sf_dir):
    return [api_pairs(spark, sf_dir, side) for side in ("old", "new")]


def o4_references(spark, sf_dir):
    return openapi.resolved_references(api_pairs(spark, sf_dir, "new"), ["page_id"]).groupBy("path", "method", "place", "ref", "found").agg(F.count("*").alias("n"))


def o6_styles(spark, sf_dir):
    rows = openapi.surfaces(api_pairs(spark, sf_dir, "new"), ["page_id"]).filter("place IN ('path', 'query')")
    return rows.groupBy("place", "name", "style").agg(F.count("*").alias("n"))


def o7_request_contracts(spark, sf_dir):
    rows = openapi.surfaces(api_pairs(spark, sf_dir, "new"), ["page_id"])
    return rows.filter("side = 'request' AND place <> 'body'").groupBy("path", "method", "place", "name", "required", "schema_json").agg(F.count("*").alias("n"))


def o8_request_bodies(spark, sf_dir):
    rows = openapi.surfaces(api_pairs(spark, sf_dir, "new"), ["page_id"])
    return rows.filter("place = 'body'").groupBy("method", "name", "required").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))


def o10_media_ranges(spark, sf_dir):
    docs = api_pairs(spark, sf_dir, "new").withColumn("doc_json", F.replace("doc_json", F.lit('"requestBody":{"$ref":"#/components/requestBodies/B"}'), F.concat(F.lit('"requestBody":{"content":{"*/*":{},"Text/Plain":{},"text/*":{}'), F.when(F.col("page_id") % 2 == 0, ',"application/json":{}').otherwise(""), F.lit("}}"))))
    rows = openapi.media_ranges(openapi.operations(docs, ["page_id"]), ["page_id"])
    return rows.groupBy("media", F.array_join("without", ",").alias("without")).agg(F.count("*").alias("n"))


def o15_issues(spark, sf_dir):
    old, new = _changed(spark, sf_dir)
    return openapi.operation_issues(old, new, ["page_id"])


def o16_report(spark, sf_dir):
    old, new = _changed(spark, sf_dir)
    return openapi.report(old, new, ["page_id"]).select("page_id", F.array_join("issues", ";").alias("issues"), "n", "is_compatible")


_BODY = '"requestBody":{%s"content":{%s}},'
_OK = '"responses":{"200":{}}'
#: Two forms of an operation, and the issue between them (none: compatible).
VERSIONS = [
    (_OK, _OK, None),
    (_OK, _BODY % ('"required":true,', '"application/json":{"schema":{"type":"object"}}') + _OK, "request body: requires a body"),
    (_OK, _BODY % ("", '"application/json":{"schema":{"type":"object"}}') + _OK, None),
    ('"responses":{"200":{"content":{"application/json":{"schema":{"type":"object"}}}}}', _OK, "response body of 200: may come without a body"),
    (_OK, '"responses":{"200":{},"404":{}}', "response: answers with status 404"),
    ('"responses":{"2XX":{"content":{"application/json":{"schema":{"type":"integer"}}}}}', '"responses":{"200":{"content":{"application/json":{"schema":{"type":"string"}}}}}', "response body of 200: application/json incompatible"),
    ('"responses":{"2XX":{"content":{"application/json":{"schema":{"type":"number"}}}}}', '"responses":{"200":{"content":{"application/json":{"schema":{"type":"integer"}}}}}', None),
    (_BODY % ("", '"application/json":{"schema":{"type":"object"}}') + _OK, _BODY % ("", '"application/*":{"schema":{"type":"string"}}') + _OK, "request body: application/json incompatible"),
    (_BODY % ("", '"application/json":{"schema":{"type":"object"}}') + _OK, _BODY % ("", '"*/*":{}') + _OK, None),
    (_BODY % ("", '"text/*":{}') + _OK, _BODY % ("", '"text/plain":{}') + _OK, "request body: no longer accepts text/*"),
    ('"responses":{"default":{}}', '"responses":{"1XX":{},"2XX":{},"3XX":{},"4XX":{},"5XX":{}}', None),
    ('"responses":{"200":{},"404":{}}', '"responses":{"200":{},"default":{}}', "response: answers with status default"),
    (_OK, '"responses":{"200":{"headers":{"X-New":{"schema":{}}}}}', "response headers of 200: answers with x-new"),
]


def o16_versions(spark, sf_dir):
    """For each page with a url two descriptions of one operation, in the forms of the page's number."""
    pages = table(spark, sf_dir, "pages").filter(F.contains("url", F.lit("://"))).select("page_id")
    side = lambda i: pages.select("page_id", F.concat(F.lit('{"openapi":"3.1.0","paths":{"/p'), F.col("page_id").cast("string"), F.lit('":{"put":{'), F.get(F.array(*(F.lit(v[i]) for v in VERSIONS)), (F.col("page_id") % len(VERSIONS)).cast("int")), F.lit("}}}}")).alias("doc_json"))
    return openapi.report(side(0), side(1), ["page_id"]).select("page_id", F.array_join("issues", ";").alias("issues"), "n", "is_compatible")


def x2_read_stamped_stream(spark, sf_dir):
    """Envelopes as a stream, stopped after the first half of the files and taken up again from its checkpoint."""
    base = checkpoint_folder(spark)
    at = f"{base}/stream-{uuid.uuid4().hex}"
    made = stamped_events(spark, sf_dir).select("event_id", "event_type", "envelope")
    for half in (0, 1):
        made.filter(F.col("event_id") % 2 == half).write.mode("append").parquet(f"{at}/in")
        source = spark.readStream.schema(made.schema).parquet(f"{at}/in")
        read = streams.read_stamped_stream(source, "envelope", {1: RECORD_VERSIONS["v3"], 3: RECORD_VERSIONS["v1"]}).select("event_type", "event_id", "version", "valid")
        streams.drain(read, f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out").groupBy("event_type", "version", "valid").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def x1_validate_stream(spark, sf_dir):
    base = checkpoint_folder(spark)
    at = f"{base}/stream-{uuid.uuid4().hex}"
    rows = streams.validate_stream(streams.table_stream(spark, sf_dir, "events"), EVENT).select("event_id", "event_type", "valid")
    streams.drain(rows, f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out").groupBy("event_type", "valid").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


QUERIES = {
    "D2_decode": d2_decode, "D3_extras": d3_extras, "D4_missing_not_null": d4_missing, "D7_round_trip_audit": d7_round_trip, "D8_tagged_union": d8_tagged, "D9_rejected": d9_rejected,
    "O1_operations": o1_operations, "O2_parameters": o2_parameters, "O5_path_templates": o5_templates, "O9_status_expansion": o9_statuses, "O14_removed_operations": o14_removed, "O15_changed_operations": o15_changed, "O15_operation_issues": o15_issues, "O4_references": o4_references, "O6_styles": o6_styles, "O7_request_contracts": o7_request_contracts, "O8_request_bodies": o8_request_bodies, "O10_media_ranges": o10_media_ranges, "O16_report": o16_report, "O16_versions": o16_versions,
    "X1_validate_stream": x1_validate_stream, "X2_read_stamped_stream": x2_read_stamped_stream,
}
_K = "CAST(json_extract(props, '$.k') AS BIGINT)"
_API = """api AS (SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) AS host, CASE WHEN page_id % 2 = 0 THEN 'old' ELSE 'new' END AS side, regexp_extract(url, '://[^/?#]*(/[^/?#]*)', 1) || '/{id}' AS path,
    CASE page_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PUT' END AS method FROM pages WHERE strpos(url, '://') > 0)"""
_GONE = "SELECT host, path, method FROM api WHERE side = 'old' EXCEPT SELECT host, path, method FROM api WHERE side = 'new'"
_BOTH = "SELECT host, path, method FROM api WHERE side = 'old' AND method = 'POST' INTERSECT SELECT host, path, method FROM api WHERE side = 'new'"
_PAGES = f"(SELECT page_id, page_id % {CHANGES} AS k FROM pages WHERE strpos(url, '://') > 0)"
#: What follows from each change, a row for each issue.
_FOUND = f"""SELECT page_id, k, '/a/{{id}}' AS path, CASE k WHEN 2 THEN 'request query' WHEN 3 THEN 'request query' WHEN 6 THEN 'request path' WHEN 7 THEN 'response headers of 200' WHEN 8 THEN 'response body of 200' ELSE 'request body' END AS surface,
    unnest(CASE k WHEN 1 THEN ['application/json incompatible'] WHEN 2 THEN ['requires q'] WHEN 3 THEN ['is written in another way: q'] WHEN 4 THEN ['requires a body'] WHEN 5 THEN ['no longer accepts text/*', 'no longer accepts text/plain']
        WHEN 6 THEN ['id incompatible'] WHEN 7 THEN ['x-id incompatible'] WHEN 8 THEN ['application/json incompatible'] ELSE [''] END) AS message FROM {_PAGES}"""
ORACLE_SQL = {
    "D2_decode": "SELECT event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users, CAST(sum(CASE WHEN event_id % 3 = 2 THEN CAST(round(value) AS BIGINT) END) AS BIGINT) AS value FROM events WHERE event_id % 17 <> 0 GROUP BY 1",
    "D3_extras": f"SELECT 'props' AS extra_keys, count(*) AS n, CAST(sum({_K}) AS BIGINT) AS k FROM events WHERE event_id % 17 <> 0",
    "D4_missing_not_null": "SELECT event_id % 3 = 0 AS missing, event_id % 3 = 1 AS is_null, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE event_id % 17 <> 0 GROUP BY 1, 2",
    "D7_round_trip_audit": "SELECT true AS same, count(*) AS n FROM events WHERE event_id % 17 <> 0",
    "D8_tagged_union": f"SELECT count(*) FILTER (WHERE event_type = 'view') AS views, CAST(sum(user_id) FILTER (WHERE event_type = 'view') AS BIGINT) AS users, count(*) FILTER (WHERE event_type = 'click') AS clicks, CAST(sum({_K}) FILTER (WHERE event_type = 'click') AS BIGINT) AS k FROM events WHERE event_id % 17 <> 0",
    "D9_rejected": "SELECT CASE WHEN event_id % 17 = 0 THEN 'rejected' ELSE 'parsed' END AS side, count(*) AS n FROM events GROUP BY 1",
    "O1_operations": f"WITH {_API} SELECT * FROM api",
    "O2_parameters": f"WITH {_API} SELECT side, method, location, name, required, count(*) AS n FROM (SELECT side, method, unnest(['path', 'header']) AS location, unnest(['id', 'x-trace']) AS name, unnest([true, side = 'new' AND method = 'POST']) AS required FROM api) GROUP BY ALL",
    "O5_path_templates": f"SELECT page_id, '/a/{{key}}' AS path, method, name FROM {_PAGES}, (VALUES ('POST'), ('GET')) m(method), (VALUES ('id'), ('key')) n(name) WHERE page_id % 4 = 0 AND (method = 'POST' OR k <> 0)",
    "O9_status_expansion": f"WITH {_API} SELECT side, CASE WHEN s = 404 THEN '404' WHEN s BETWEEN 200 AND 299 THEN '2XX' ELSE 'default' END AS entry, count(*) AS n FROM api, range(100, 600) r(s) GROUP BY 1, 2",
    "O14_removed_operations": f"WITH {_API} {_GONE}",
    "O15_changed_operations": f"WITH {_API} {_BOTH}",
    "O4_references": f"""SELECT '/a/{{id}}' AS path, 'POST' AS method, 'parameter' AS place, '#/components/parameters/P' AS ref, '{{"in":"query","name":"q","required":' || (k = 2) || ',"schema":{{"type":"string"}}' || CASE k WHEN 3 THEN ',"style":"pipeDelimited"' ELSE '' END || '}}' AS found, count(*) AS n FROM {_PAGES} GROUP BY ALL
        UNION ALL SELECT '/a/{{id}}', 'POST', 'body', '#/components/requestBodies/B', '{{"content":{{"application/json":{{"schema":{{"properties":{{"v":{{"$ref":"#/components/schemas/S"}}}},"type":"object"}}}}' || CASE k WHEN 5 THEN '' ELSE ',"text/*":{{}},"text/plain":{{}}' END || '}},"required":' || (k = 4) || '}}', count(*) FROM {_PAGES} GROUP BY ALL""",
    "O6_styles": f"SELECT place, name, style, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'path' AS place, 'id' AS name, 'simple false' AS style, count(*) AS n FROM {_PAGES} UNION ALL SELECT 'path', 'id', 'simple false', count(*) FROM {_PAGES} WHERE k <> 0 UNION ALL SELECT 'query', 'q', CASE k WHEN 3 THEN 'pipeDelimited false' ELSE 'form true' END, count(*) FROM {_PAGES} GROUP BY ALL) GROUP BY ALL",
    "O7_request_contracts": f"""SELECT path, method, place, name, required, schema_json, count(*) AS n FROM (SELECT '/a/{{id}}' AS path, unnest(CASE k WHEN 0 THEN ['POST'] ELSE ['POST', 'GET'] END) AS method, 'path' AS place, 'id' AS name, true AS required, CASE k WHEN 6 THEN '{{"enum":["x"]}}' ELSE '{{"enum":["x","y"]}}' END AS schema_json FROM {_PAGES}) GROUP BY ALL
        UNION ALL SELECT '/a/{{id}}', 'POST', 'query', 'q', k = 2, '{{"type":"string"}}', count(*) FROM {_PAGES} GROUP BY ALL""",
    "O8_request_bodies": f"SELECT method, name, required, count(*) AS n, min(page_id) AS first FROM (SELECT page_id, 'POST' AS method, unnest(CASE k WHEN 5 THEN ['application/json'] ELSE ['application/json', 'text/*', 'text/plain'] END) AS name, k = 4 AS required FROM {_PAGES}) GROUP BY ALL",
    "O10_media_ranges": f"""SELECT media, without, count(*) AS n FROM (SELECT unnest(CASE page_id % 2 WHEN 0 THEN ['*/*', 'text/plain', 'text/*', 'application/json'] ELSE ['*/*', 'text/plain', 'text/*'] END) AS media,
        unnest(CASE page_id % 2 WHEN 0 THEN ['application/json,text/*,text/plain', '', 'text/plain', ''] ELSE ['text/*,text/plain', '', 'text/plain'] END) AS without FROM {_PAGES}) GROUP BY ALL""",
    "O15_operation_issues": f"SELECT page_id, path, unnest(CASE k WHEN 6 THEN ['POST', 'GET'] ELSE ['POST'] END) AS method, surface, message FROM ({_FOUND}) WHERE k <> 0",
    "O16_report": f"""SELECT page_id, CASE k WHEN 0 THEN 'GET /a/{{id}} was removed' WHEN 6 THEN 'GET ' || path || ' ' || surface || ': ' || min(message) || ';POST ' || path || ' ' || surface || ': ' || min(message) ELSE string_agg('POST ' || path || ' ' || surface || ': ' || message, ';' ORDER BY message) END AS issues,
        CASE k WHEN 5 THEN 2 WHEN 6 THEN 2 ELSE 1 END AS n, false AS is_compatible FROM ({_FOUND}) GROUP BY page_id, path, k, surface""",
    "X1_validate_stream": f"SELECT event_type, coalesce(({EVENT_SQL}), false) AS valid, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1, 2",
}
_CASES = " ".join(f"WHEN {i} THEN {'NULL' if v[2] is None else repr('PUT /p') + ' || page_id || ' + repr(' ' + v[2])}" for i, v in enumerate(VERSIONS))
ORACLE_SQL["O16_versions"] = f"SELECT page_id, coalesce(i, '') AS issues, CAST(i IS NOT NULL AS INTEGER) AS n, i IS NULL AS is_compatible FROM (SELECT page_id, CASE page_id % {len(VERSIONS)} {_CASES} END AS i FROM pages WHERE strpos(url, '://') > 0)"
ORACLE_SQL["X2_read_stamped_stream"] = REGISTRY_SQL["T9_read_stamped"]
