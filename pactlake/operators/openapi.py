"""OpenAPI 3.1 descriptions as rows: operations, parameters, statuses, and the difference of two descriptions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlake.functions.settled import settle

from .compat import check_compat
from .registry_scan import let

METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")
IGNORED_HEADERS = ("accept", "content-type", "authorization")


def _entries(v: Column) -> Column:
    return F.explode(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")))


def is_openapi(text: str = "doc_json") -> Column:
    keys = F.json_object_keys(text)
    return F.coalesce(F.array_contains(keys, "openapi") & F.arrays_overlap(keys, F.array(*map(F.lit, ("paths", "components", "webhooks")))), F.lit(False))


def operations(docs: DataFrame, ids: list[str]) -> DataFrame:
    """(ids..., path, method, item VARIANT, op VARIANT) of documents (ids..., doc_json); extension paths left out."""
    doc = F.try_parse_json("doc_json")
    paths = docs.select(*ids, _entries(F.try_variant_get(doc, "$.paths", "variant")).alias("p")).filter(~F.col("p.key").startswith("x-"))
    ops = paths.select(*ids, F.col("p.key").alias("path"), F.col("p.value").alias("item"), _entries(F.col("p.value")).alias("o"))
    return ops.filter(F.col("o.key").isin(*METHODS)).select(*ids, "path", F.upper("o.key").alias("method"), "item", F.col("o.value").alias("op"))


def parameters(ops: DataFrame, ids: list[str]) -> DataFrame:
    """(ids..., path, method, location, name, required, param VARIANT): the operation's own before the path's; header
    names in lower case, without those that other fields describe."""
    listed = lambda v, level: F.transform(F.coalesce(F.try_variant_get(v, "$.parameters", "array<variant>"), F.array().cast("array<variant>")), lambda p: F.struct(F.lit(level).alias("level"), p.alias("p")))
    rows = ops.select(*ids, "path", "method", F.explode(F.concat(listed(F.col("op"), 0), listed(F.col("item"), 1))).alias("x"))
    get = lambda k, t: F.try_variant_get("x.p", f"$['{k}']", t)
    location = get("in", "string")
    name = F.when(location == "header", F.lower(get("name", "string"))).otherwise(get("name", "string"))
    cols = rows.select(*ids, "path", "method", location.alias("location"), name.alias("name"), F.coalesce(get("required", "boolean"), F.lit(False)).alias("required"), F.col("x.level").alias("level"), F.to_json("x.p").alias("param"))
    cols = cols.filter((F.col("location") != "header") | ~F.col("name").isin(*IGNORED_HEADERS))
    best = F.min_by(F.struct("required", "param"), "level").alias("b")
    return cols.groupBy(*ids, "path", "method", "location", "name").agg(best).select(*ids, "path", "method", "location", "name", "b.required", "b.param")


def template_mismatches(ops: DataFrame, params: DataFrame, ids: list[str]) -> DataFrame:
    """(ids..., path, method, name): names in a path template without a required path parameter, and path parameters
    that the template doesn't have."""
    key = [*ids, "path", "method", "name"]
    names = ops.select(*ids, "path", "method", F.explode(F.regexp_extract_all("path", F.lit(r"\{([^}]+)\}"), 1)).alias("name"))
    own = params.filter("location = 'path'")
    return names.join(own.filter("required"), key, "left_anti").unionByName(own.select(*key).join(names, key, "left_anti"))


def statuses(ops: DataFrame, ids: list[str]) -> DataFrame:
    """(ids..., path, method, status, entry): every status from 100 to 599 that a response entry covers; exact codes
    before classes like 2XX, classes before default."""
    keys = F.map_keys(F.try_variant_get("op", "$.responses", "map<string,variant>"))
    rows = ops.select(*ids, "path", "method", keys.alias("k")).withColumn("status", F.explode(F.sequence(F.lit(100), F.lit(599))))
    code = F.col("status").cast("string")
    family = F.concat(F.substr(code, F.lit(1), F.lit(1)), F.lit("XX"))
    entry = F.when(F.array_contains("k", code), code).when(F.array_contains("k", family), family).when(F.array_contains("k", "default"), F.lit("default"))
    return rows.withColumn("entry", entry).filter("entry IS NOT NULL").drop("k")


def media_covered(ranges: Column, media: Column) -> Column:
    """The most specific of the given ranges that covers a media type."""
    kind = F.lower(F.trim(F.split_part(media, F.lit(";"), F.lit(1))))
    wide = F.concat(F.split_part(kind, F.lit("/"), F.lit(1)), F.lit("/*"))
    return F.when(F.array_contains(ranges, kind), kind).when(F.array_contains(ranges, wide), wide).when(F.array_contains(ranges, "*/*"), F.lit("*/*"))


def _fields(v: Column, path: str) -> Column:
    """The keys of the object at a path; none where it is missing or no object."""
    return F.coalesce(F.map_keys(F.try_variant_get(v, path, "map<string,variant>")), F.array().cast("array<string>"))


def duplicate_media(ops: DataFrame, ids: list[str]) -> DataFrame:
    """(ids..., path, method, media, n): media types of a request body that are the same but for case and spaces."""
    media = F.transform(_fields(F.col("op"), "$.requestBody.content"), lambda k: F.regexp_replace(F.lower(F.trim(k)), r"\s*;\s*", ";"))
    rows = ops.select(*ids, "path", "method", F.explode(media).alias("media"))
    return rows.groupBy(*ids, "path", "method", "media").agg(F.count("*").alias("n")).filter("n > 1")


def response_headers(ops: DataFrame, ids: list[str]) -> DataFrame:
    """(ids..., path, method, entry, header, n): header names in lower case without content-type; n > 1: a duplicate."""
    responses = ops.select(*ids, "path", "method", _entries(F.try_variant_get("op", "$.responses", "variant")).alias("r"))
    rows = responses.select(*ids, "path", "method", F.col("r.key").alias("entry"), F.explode(F.transform(_fields(F.col("r.value"), "$.headers"), F.lower)).alias("header"))
    return rows.filter("header <> 'content-type'").groupBy(*ids, "path", "method", "entry", "header").agg(F.count("*").alias("n"))


def unsupported_surfaces(docs: DataFrame, ids: list[str]) -> DataFrame:
    """(ids..., place, surface): webhooks, references in place of a path's operations, callbacks, links, encodings and
    references to other documents."""
    doc = F.try_parse_json("doc_json")
    hooks = docs.select(*ids, F.explode(_fields(doc, "$.webhooks")).alias("place"), F.lit("webhook").alias("surface"))
    items = docs.select(*ids, _entries(F.try_variant_get(doc, "$.paths", "variant")).alias("p"))
    refs = items.filter(F.array_contains(_fields(F.col("p.value"), "$"), "$ref")).select(*ids, F.col("p.key").alias("place"), F.lit("path reference").alias("surface"))
    ops = operations(docs, ids)
    calls = ops.filter(F.array_contains(_fields(F.col("op"), "$"), "callbacks")).select(*ids, F.concat_ws(" ", "method", "path").alias("place"), F.lit("callbacks").alias("surface"))
    answers = ops.select(*ids, "path", "method", _entries(F.try_variant_get("op", "$.responses", "variant")).alias("r"))
    links = answers.filter(F.size(_fields(F.col("r.value"), "$.links")) > 0).select(*ids, F.concat_ws(" ", "method", "path", "r.key").alias("place"), F.lit("links").alias("surface"))
    coded = ops.select(*ids, "path", "method", F.explode(_media(F.try_variant_get("op", "$.requestBody", "variant"))).alias("m")).filter(F.array_contains(_fields(F.col("m.value"), "$"), "encoding"))
    coded = coded.select(*ids, F.concat_ws(" ", "method", "path", "m.key").alias("place"), F.lit("encoding").alias("surface"))
    far = ops.filter(F.to_json("op").rlike(r'"\$ref":"[^#]')).select(*ids, F.concat_ws(" ", "method", "path").alias("place"), F.lit("remote reference").alias("surface"))
    return reduce(DataFrame.unionByName, [hooks, refs, calls, links, coded, far])


def duplicate_parameters(docs: DataFrame, ids: list[str]) -> DataFrame:
    """(ids..., path, method, level, location, name, n): parameters that one list names more than once, by reference or in
    place, header names in any case; level: operation or path. Header names that other fields describe don't count."""
    ops = operations(docs, ids).join(docs.select(*ids, F.try_parse_json("doc_json").alias("_doc")), ids)
    listed = lambda v, level: F.transform(F.coalesce(F.try_variant_get(v, "$.parameters", "array<variant>"), F.array().cast("array<variant>")), lambda p: F.struct(F.lit(level).alias("level"), component(F.col("_doc"), p).alias("p")))
    rows = ops.select(*ids, "path", "method", F.explode(F.concat(listed(F.col("op"), "operation"), listed(F.col("item"), "path"))).alias("x"))
    get = lambda k: F.try_variant_get("x.p", f"$['{k}']", "string")
    name = F.when(get("in") == "header", F.lower(get("name"))).otherwise(get("name"))
    named = rows.select(*ids, "path", "method", "x.level", get("in").alias("location"), name.alias("name")).filter("location IS NOT NULL AND name IS NOT NULL")
    named = named.filter((F.col("location") != "header") | ~F.col("name").isin(*IGNORED_HEADERS))
    return named.groupBy(*ids, "path", "method", "level", "location", "name").agg(F.count("*").alias("n")).filter("n > 1")


#: How a parameter is written: default style by place, and the styles that each place may have.
STYLES = {"path": ("simple", "label", "matrix"), "query": ("form", "spaceDelimited", "pipeDelimited", "deepObject"), "header": ("simple",), "cookie": ("form",)}


def component(doc: Column, v: Column, hops: int = 4) -> Column:
    """What a local reference into components leads to, through chains of up to `hops`; other values as they are. NULL
    where the target is missing or further away."""

    def hop(v: Column) -> Column:
        parts = F.split(F.try_variant_get(v, "$['$ref']", "string"), "/")
        name = F.replace(F.replace(F.get(parts, F.lit(3)), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
        section = F.try_element_at(F.try_variant_get(doc, "$.components", "map<string,variant>"), F.get(parts, F.lit(2)))
        return F.when(parts.isNull(), v).when((F.get(parts, F.lit(0)) == "#") & (F.get(parts, F.lit(1)) == "components"), F.try_element_at(F.try_variant_get(section, "$", "map<string,variant>"), name))

    for _ in range(hops):
        v = let(v, hop)
    return let(v, lambda x: F.when(F.try_variant_get(x, "$['$ref']", "string").isNull(), x))


def resolved_references(docs: DataFrame, ids: list[str]) -> DataFrame:
    """(ids..., path, method, place, ref, found): references that stand for a parameter, a body or a response."""
    ops = operations(docs, ids)
    doc = F.try_parse_json("doc_json")
    listed = lambda v: F.coalesce(F.try_variant_get(v, "$.parameters", "array<variant>"), F.array().cast("array<variant>"))
    of = lambda place, v: F.struct(F.lit(place).alias("place"), v.alias("v"))
    spots = F.concat(F.transform(listed(F.col("op")), lambda v: of("parameter", v)), F.array(of("body", F.try_variant_get("op", "$.requestBody", "variant"))), F.transform(F.map_values(F.coalesce(F.try_variant_get("op", "$.responses", "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))), lambda v: of("response", v)))
    rows = ops.select(*ids, "path", "method", F.explode(spots).alias("x")).withColumn("ref", F.try_variant_get("x.v", "$['$ref']", "string")).filter("ref IS NOT NULL")
    met = rows.join(docs.select(*ids, doc.alias("doc")), ids)
    return met.select(*ids, "path", "method", "x.place", "ref", F.to_json(component(F.col("doc"), F.col("x.v"))).alias("found"))


def parameter_styles(params: DataFrame) -> DataFrame:
    """params with style, explode (defaults filled in) and allowed: whether the place may have the style."""
    p = F.try_parse_json("param")
    first = F.create_map(*(x for k, v in STYLES.items() for x in (F.lit(k), F.lit(v[0]))))
    may = F.create_map(*(x for k, v in STYLES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    style = F.coalesce(F.try_variant_get(p, "$.style", "string"), F.try_element_at(first, "location"))
    with_style = params.withColumn("style", style).withColumn("explode", F.coalesce(F.try_variant_get(p, "$.explode", "boolean"), F.col("style") == "form"))
    return with_style.withColumn("allowed", F.coalesce(F.array_contains(F.try_element_at(may, "location"), F.col("style")), F.lit(False)))


def _media(v: Column) -> Column:
    """The entries of content, media types in lower case without spaces around the semicolons."""
    found = F.coalesce(F.map_entries(F.try_variant_get(v, "$.content", "map<string,variant>")), F.from_json(F.lit("[]"), "array<struct<key:string,value:variant>>"))
    return F.transform(found, lambda e: F.struct(F.regexp_replace(F.lower(F.trim(e["key"])), r"\s*;\s*", ";").alias("key"), e["value"].alias("value")))


def _wider(media: Column) -> Column:
    """The ranges that cover a media type, the narrowest first, itself among them."""
    kind = F.split_part(media, F.lit(";"), F.lit(1))
    return F.array_distinct(F.array(media, kind, F.concat(F.split_part(kind, F.lit("/"), F.lit(1)), F.lit("/*")), F.lit("*/*")))


def media_ranges(ops: DataFrame, ids: list[str]) -> DataFrame:
    """(ids..., path, method, media, without): the media types of a request body; from a range, the more specific
    entries beside it are taken out."""
    rows = ops.select(*ids, "path", "method", F.array_distinct(F.transform(_media(F.try_variant_get("op", "$.requestBody", "variant")), lambda e: e["key"])).alias("all"))
    each = rows.select(*ids, "path", "method", "all", F.explode("all").alias("media"))
    return each.select(*ids, "path", "method", "media", F.array_sort(F.filter("all", lambda m: (m != F.col("media")) & F.array_contains(_wider(m), F.col("media")))).alias("without"))


def _schema(doc: Column, v: Column) -> Column:
    """The schema of a parameter, header or media type, with the components where it refers to them."""
    text = F.coalesce(F.to_json(F.try_variant_get(v, "$.schema", "variant")), F.lit("{}"))
    kept = F.coalesce(F.to_json(F.try_variant_get(doc, "$.components", "variant")), F.lit("{}"))
    return F.when(F.contains(text, F.lit('"$ref"')), F.concat(F.lit('{"allOf":['), text, F.lit('],"components":'), kept, F.lit("}"))).otherwise(text)


def surfaces(docs: DataFrame, ids: list[str]) -> DataFrame:
    """(ids..., path, method, side, place, name, required, style, schema_json): what requests and responses of each
    operation carry: parameters by place and name, bodies by media type, responses by status entry and media type,
    their headers by name. Schemas keep the components that their references need."""
    parsed = docs.withColumn("_doc", F.try_parse_json("doc_json"))
    ops = operations(docs, ids).join(parsed.select(*ids, "_doc"), ids)
    schema = lambda v: _schema(F.col("_doc"), v)
    listed = lambda v, level: F.transform(F.coalesce(F.try_variant_get(v, "$.parameters", "array<variant>"), F.array().cast("array<variant>")), lambda p: F.struct(F.lit(level).alias("level"), component(F.col("_doc"), p).alias("p")))
    own = ops.select(*ids, "path", "method", "_doc", F.explode(F.concat(listed(F.col("op"), 0), listed(F.col("item"), 1))).alias("x"))
    get = lambda k, t: F.try_variant_get("x.p", f"$['{k}']", t)
    name = F.when(get("in", "string") == "header", F.lower(get("name", "string"))).otherwise(get("name", "string"))
    own = own.select(*ids, "path", "method", get("in", "string").alias("location"), name.alias("name"), F.coalesce(get("required", "boolean"), F.lit(False)).alias("required"), F.to_json("x.p").alias("param"), schema(F.col("x.p")).alias("schema_json"), "x.level")
    own = own.filter((F.col("location") != "header") | ~F.col("name").isin(*IGNORED_HEADERS))
    own = own.groupBy(*ids, "path", "method", "location", "name").agg(F.min_by(F.struct("required", "param", "schema_json"), "level").alias("b")).select(*ids, "path", "method", "location", "name", "b.*")
    styled = parameter_styles(own).select(*ids, "path", "method", F.lit("request").alias("side"), F.col("location").alias("place"), "name", "required", F.concat_ws(" ", "style", F.col("explode").cast("string")).alias("style"), "schema_json")
    body = component(F.col("_doc"), F.try_variant_get("op", "$.requestBody", "variant"))
    bodies = ops.select(*ids, "path", "method", "_doc", F.coalesce(F.try_variant_get(body, "$.required", "boolean"), F.lit(False)).alias("required"), F.explode(_media(body)).alias("m"))
    bodies = bodies.select(*ids, "path", "method", F.lit("request").alias("side"), F.lit("body").alias("place"), F.col("m.key").alias("name"), "required", F.lit("").alias("style"), schema(F.col("m.value")).alias("schema_json"))
    answers = ops.select(*ids, "path", "method", "_doc", _entries(F.try_variant_get("op", "$.responses", "variant")).alias("r")).withColumn("v", component(F.col("_doc"), F.col("r.value")))
    answer = lambda place, x, need, style: answers.select(*ids, "path", "method", "_doc", F.concat(F.lit(place), F.col("r.key")).alias("place"), F.explode(x).alias("m")).select(*ids, "path", "method", F.lit("response").alias("side"), "place", F.col("m.key").alias("name"), need.alias("required"), style.alias("style"), schema(F.col("m.value")).alias("schema_json"))
    headers = F.filter(F.transform(F.coalesce(F.map_entries(F.try_variant_get("v", "$.headers", "map<string,variant>")), F.from_json(F.lit("[]"), "array<struct<key:string,value:variant>>")), lambda e: F.struct(F.lower(e["key"]).alias("key"), component(F.col("_doc"), e["value"]).alias("value"))), lambda e: e["key"] != "content-type")
    told = answer("body of ", _media(F.col("v")), F.lit(True), F.lit("")).unionByName(answer("headers of ", headers, F.coalesce(F.try_variant_get("m.value", "$.required", "boolean"), F.lit(False)), F.concat(F.lit("simple "), F.coalesce(F.try_variant_get("m.value", "$.explode", "boolean"), F.lit(False)).cast("string"))))
    return styled.unionByName(bodies).unionByName(told)


#: The classes of statuses; an entry is a status, one of these, or default.
CLASSES = ("1XX", "2XX", "3XX", "4XX", "5XX")


def status_cells(old: Column, new: Column) -> Column:
    """The entries of both sides that still stand for some status when the more specific ones are taken out of a class and
    those and the classes out of default: every status from 100 to 599 is in just one."""
    both = F.array_union(old, new)
    full = lambda xs, c: F.size(F.filter(xs, lambda e: e.rlike("^[1-5][0-9][0-9]$") & (F.substr(e, F.lit(1), F.lit(1)) == c[0]))) >= 100
    covered = lambda xs: F.forall(F.array(*(F.array_contains(xs, c) | full(xs, c) for c in CLASSES)), lambda x: x)
    emptied = lambda xs, e: reduce(lambda x, y: x | y, ((e == c) & full(xs, c) for c in CLASSES)) | ((e == "default") & covered(xs))
    return F.filter(both, lambda e: ~emptied(both, e))


def status_entry(entries: Column, cell: Column) -> Column:
    """The entry of one side that speaks for a cell; NULL if none does."""
    family = F.concat(F.substr(cell, F.lit(1), F.lit(1)), F.lit("XX"))
    return F.when(F.array_contains(entries, cell), cell).when((cell != "default") & F.array_contains(entries, family), family).when(F.array_contains(entries, "default"), F.lit("default"))


def _kind(media: Column) -> Column:
    return F.trim(F.split_part(media, F.lit(";"), F.lit(1)))


def media_entry(kinds: Column, cell: Column) -> Column:
    """The narrowest of the media types and ranges that covers a cell; NULL if none does."""
    wide = F.concat(F.split_part(cell, F.lit("/"), F.lit(1)), F.lit("/*"))
    return F.when(F.array_contains(kinds, cell), cell).when((cell != "*/*") & F.array_contains(kinds, wide), wide).when(F.array_contains(kinds, "*/*"), F.lit("*/*"))


def bodies(docs: DataFrame, ids: list[str]) -> DataFrame:
    """(ids..., path, method, part, entry, bare, media MAP): what requests (entry body) and each response entry may carry:
    bare, whether there may be no body, and by media type or range, parameters aside, the schema."""
    parsed = docs.withColumn("_doc", F.try_parse_json("doc_json"))
    ops = operations(docs, ids).join(parsed.select(*ids, "_doc"), ids)
    asked = ops.select(*ids, "path", "method", "_doc", F.lit("request").alias("part"), F.lit("body").alias("entry"), component(F.col("_doc"), F.try_variant_get("op", "$.requestBody", "variant")).alias("v"))
    told = ops.select(*ids, "path", "method", "_doc", _entries(F.try_variant_get("op", "$.responses", "variant")).alias("r")).filter(~F.col("r.key").startswith("x-"))
    told = told.select(*ids, "path", "method", "_doc", F.lit("response").alias("part"), F.col("r.key").alias("entry"), component(F.col("_doc"), F.col("r.value")).alias("v"))
    rows = asked.unionByName(told).withColumn("m", F.transform(_media(F.col("v")), lambda e: F.struct(_kind(e["key"]).alias("key"), _schema(F.col("_doc"), e["value"]).alias("value"))))
    # Of media types that differ in parameters alone the first counts; duplicate_media reports those that are the same.
    keys = F.array_distinct(F.transform("m", lambda e: e["key"]))
    media = F.map_from_arrays(keys, F.transform(keys, lambda k: F.filter("m", lambda e: e["key"] == k)[0]["value"]))
    bare = F.when(F.col("part") == "request", ~F.coalesce(F.try_variant_get("v", "$.required", "boolean"), F.lit(False)) | (F.size("m") == 0)).otherwise(F.size("m") == 0)
    return rows.select(*ids, "path", "method", "part", "entry", bare.alias("bare"), media.alias("media"))


def _sided(df: DataFrame, key: list[str], side: str) -> DataFrame:
    return df.select(*key, *(F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in key))


def operation_issues(old: DataFrame, new: DataFrame, ids: list[str]) -> DataFrame:
    """(ids..., path, method, surface, message) for documents (ids..., doc_json) whose operations are in both. What old
    clients send must be accepted by the new side (requests as deserializer), what the new side answers by old clients
    (responses as serializer). Statuses and media types are cut into cells that one entry of each side speaks for, so that
    schemas meet wherever two entries overlap; no body is an alternative of its own. Groups of parameters and headers are
    closed. A pair of schemas that can't be decided is an issue too."""
    op = [*ids, "path", "method"]
    both = settle(operations(old, ids).select(*op).join(operations(new, ids).select(*op), op))
    o, n = (settle(surfaces(d, ids).join(both, op, "left_semi")) for d in (old, new))
    ob, nb = (settle(bodies(d, ids).join(both, op, "left_semi")) for d in (old, new))
    none = F.array().cast("array<string>")
    listed = lambda df, name: df.filter("part = 'response'").groupBy(*op).agg(F.array_sort(F.collect_set("entry")).alias(name))
    # Statuses: which entries of both sides meet, and where only the new one answers.
    cells = both.join(listed(ob, "o"), op, "left").join(listed(nb, "n"), op, "left").select(*op, F.coalesce("o", none).alias("o"), F.coalesce("n", none).alias("n"))
    cells = cells.select(*op, "o", "n", F.explode(status_cells(F.col("o"), F.col("n"))).alias("cell"))
    met = settle(cells.select(*op, "cell", status_entry(F.col("o"), F.col("cell")).alias("o_entry"), status_entry(F.col("n"), F.col("cell")).alias("n_entry")).filter("n_entry IS NOT NULL"))
    fresh = met.filter("o_entry IS NULL").select(*op, F.lit("response").alias("surface"), F.concat(F.lit("answers with status "), "cell").alias("message"))
    pairs = met.filter("o_entry IS NOT NULL").groupBy(*op, "o_entry", "n_entry").agg(F.min("cell").alias("cell"))
    # Bodies: sub is what is sent, sup what is understood.
    asked = _sided(ob.filter("part = 'request'"), op, "sub").join(_sided(nb.filter("part = 'request'"), op, "sup"), op).withColumns({"surface": F.lit("request body"), "role": F.lit("deserializer")})
    answers = lambda df, side, entry: _sided(df.filter("part = 'response'"), op, side).withColumnRenamed(f"{side}_entry", entry)
    told = pairs.join(answers(nb, "sub", "n_entry"), [*op, "n_entry"]).join(answers(ob, "sup", "o_entry"), [*op, "o_entry"]).withColumns({"surface": F.concat(F.lit("response body of "), "cell"), "role": F.lit("serializer")})
    cols = [*op, "surface", "role", "sub_bare", "sub_media", "sup_bare", "sup_media"]
    carried = settle(asked.select(*cols).unionByName(told.select(*cols)))
    request = F.col("role") == "deserializer"
    bare = carried.filter("sub_bare AND NOT sup_bare").select(*op, "surface", F.when(request, "requires a body").otherwise("may come without a body").alias("message"))
    at = carried.select(*op, "surface", "role", "sub_media", "sup_media", F.explode(F.array_union(F.map_keys("sub_media"), F.map_keys("sup_media"))).alias("cell"))
    at = at.select(*op, "surface", "role", "cell", "sub_media", "sup_media", media_entry(F.map_keys("sub_media"), F.col("cell")).alias("sub"), media_entry(F.map_keys("sup_media"), F.col("cell")).alias("sup")).filter("sub IS NOT NULL")
    foreign = at.filter("sup IS NULL").select(*op, "surface", F.concat(F.when(request, "no longer accepts ").otherwise("answers with "), "cell").alias("message"))
    typed = at.filter("sup IS NOT NULL").select(*op, "surface", "role", F.col("cell").alias("name"), F.try_element_at("sub_media", "sub").alias("sub"), F.try_element_at("sup_media", "sup").alias("sup"))
    # Parameters by place and name, headers by the entries that meet.
    spot = [*op, "surface", "name"]
    fields = ["required", "style", "schema_json"]
    params = [_sided(df.filter("side = 'request' AND place <> 'body'").select(*op, F.concat(F.lit("request "), "place").alias("surface"), "name", *fields), spot, side) for df, side in ((o, "o"), (n, "n"))]
    heads = lambda df, entry: df.filter("place LIKE 'headers of %'").select(*op, F.expr("substring(place, 12)").alias(entry), "name", *fields)
    tops = [_sided(pairs.join(heads(df, f"{side}_entry"), [*op, f"{side}_entry"]).select(*op, F.concat(F.lit("response headers of "), "cell").alias("surface"), "name", *fields), spot, side) for df, side in ((o, "o"), (n, "n"))]
    named = settle(params[0].join(params[1], spot, "full_outer").unionByName(tops[0].join(tops[1], spot, "full_outer")))
    head, gone, added = F.startswith("surface", F.lit("response")), F.col("n_schema_json").isNull(), F.col("o_schema_json").isNull()
    why = F.array_compact(F.array(
        F.when(~head & gone, F.concat(F.lit("no longer accepts "), "name")), F.when(~head & ~gone & F.col("n_required") & ~F.coalesce("o_required", F.lit(False)), F.concat(F.lit("requires "), "name")),
        F.when(~gone & ~added & (F.col("o_style") != F.col("n_style")), F.concat(F.lit("is written in another way: "), "name")),
        F.when(head & added, F.concat(F.lit("answers with "), "name")), F.when(head & F.col("o_required") & (gone | ~F.col("n_required")), F.concat(F.lit("may lack "), "name")),
    ))
    shape = named.select(*op, "surface", F.explode(why).alias("message"))
    same = named.filter(~gone & ~added).select(*op, "surface", F.when(head, "serializer").otherwise("deserializer").alias("role"), "name", F.when(head, F.col("n_schema_json")).otherwise(F.col("o_schema_json")).alias("sub"), F.when(head, F.col("o_schema_json")).otherwise(F.col("n_schema_json")).alias("sup"))
    compared = typed.unionByName(same).filter("sub <> sup").withColumns({"old": F.when(request, F.col("sub")).otherwise(F.col("sup")), "new": F.when(request, F.col("sup")).otherwise(F.col("sub"))})
    judged = check_compat(compared.select(*spot, "role", "old", "new"), spot).filter("verdict <> 'compatible'")
    schema = judged.select(*op, "surface", F.concat_ws(" ", "name", "verdict").alias("message"))
    return reduce(DataFrame.unionByName, [fresh, bare, foreign, shape, schema])


def removed_operations(old: DataFrame, new: DataFrame, ids: list[str]) -> DataFrame:
    return old.join(new.select(*ids, "path", "method"), [*ids, "path", "method"], "left_anti").select(*ids, "path", "method")


def changed_operations(old: DataFrame, new: DataFrame, ids: list[str]) -> DataFrame:
    """(ids..., path, method, old_op, new_op) whose texts differ, the path's own parameters included."""
    text = lambda df, name: df.select(*ids, "path", "method", F.to_json(F.struct("op", F.try_variant_get("item", "$.parameters", "variant").alias("shared"))).alias(name))
    return text(old, "old_op").join(text(new, "new_op"), [*ids, "path", "method"]).filter("old_op <> new_op")


def report(old: DataFrame, new: DataFrame, ids: list[str]) -> DataFrame:
    """(ids..., issues, n, is_compatible) for every pair of documents (ids..., doc_json); issues: METHOD path surface:
    message, in order. A parameter that either side lists twice is an issue, as nothing says which one counts."""
    gone = removed_operations(operations(old, ids), operations(new, ids), ids).select(*ids, F.concat_ws(" ", "method", "path", F.lit("was removed")).alias("issue"))
    broken = operation_issues(old, new, ids).select(*ids, F.concat(F.concat_ws(" ", "method", "path", "surface"), F.lit(": "), "message").alias("issue"))
    twice = duplicate_parameters(old, ids).unionByName(duplicate_parameters(new, ids)).select(*ids, F.concat(F.concat_ws(" ", "method", "path", F.lit("request"), "location"), F.lit(": lists twice "), "name").alias("issue"))
    counted = gone.unionByName(broken).unionByName(twice).groupBy(*ids).agg(F.array_sort(F.collect_set("issue")).alias("issues"))
    pairs = old.select(*ids).unionByName(new.select(*ids)).distinct()
    return pairs.join(counted, ids, "left").select(*ids, F.coalesce("issues", F.array().cast("array<string>")).alias("issues"), F.coalesce(F.size("issues"), F.lit(0)).alias("n"), F.col("issues").isNull().alias("is_compatible"))
