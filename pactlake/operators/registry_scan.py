"""A registry table (ids..., schema_json) flattened into schema nodes and constraint rows, without shuffles."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactlake.functions.settled import settle
from pactlake.functions.values import EXACT, Variant

SINGLE = ("additionalProperties", "items", "not", "if", "then", "else", "contains", "propertyNames", "unevaluatedItems", "unevaluatedProperties", "contentSchema")
MAPS = ("properties", "patternProperties", "$defs", "definitions", "dependentSchemas")
LISTS = ("allOf", "anyOf", "oneOf", "prefixItems")
#: Keywords that verdicts don't model (warned about), and those that no document may have.
WARNED = ("unevaluatedItems", "unevaluatedProperties", "contentEncoding", "contentMediaType", "contentSchema", "dependentSchemas", "minContains", "maxContains")
HARD = ("$id", "$anchor", "$dynamicRef", "$dynamicAnchor")
DIALECTS = ("https://json-schema.org/draft/2020-12/schema", "https://spec.openapis.org/oas/3.1/dialect/base")
#: Keywords that mean something for one type only.
OF_TYPE = {"string": ("minLength", "maxLength", "pattern"), "number": ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"), "array": ("items", "prefixItems", "minItems", "maxItems", "uniqueItems", "contains"), "object": ("properties", "required", "minProperties", "maxProperties", "additionalProperties", "patternProperties", "propertyNames", "dependentRequired")}
#: Patterns that can be tried on single values without surprises.
SAFE_PATTERN = r"^\^?(?:(?:[A-Za-z0-9_ /:-]|\[(?:a-z|A-Z|0-9|1-9|a-f|A-F|[A-Za-z0-9_])+\]|\\[dwsDWS.]|\.)(?:[*+?]|\{[0-9]+,?\})?)*\$?$"
_NODES = "array<struct<pointer:string,node:variant>>"
SAFE = 2**53 - 1
#: Divisors of a million: a step with up to six digits after the point is whole that many times.
_SHARES = sorted(2**i * 5**j for i in range(7) for j in range(7))


def escaped(key: Column) -> Column:
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def _entries(v: Column) -> Column:
    return F.coalesce(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), F.from_json(F.lit("[]"), "array<struct<key:string,value:variant>>"))


def _children(n: Column) -> Column:
    made = lambda pointer, node: F.struct(pointer.alias("pointer"), node.alias("node"))

    def of(e: Column) -> Column:
        at = F.concat(n["pointer"], F.lit("/"), escaped(e["key"]))
        in_map = F.transform(_entries(e["value"]), lambda x: made(F.concat(at, F.lit("/"), escaped(x["key"])), x["value"]))
        in_list = F.transform(F.coalesce(F.try_variant_get(e["value"], "$", "array<variant>"), F.array().cast("array<variant>")), lambda x, i: made(F.concat(at, F.lit("/"), i.cast("string")), x))
        # Descriptions of APIs keep the schemas that references point to in components/schemas.
        held = F.transform(_entries(F.try_variant_get(e["value"], "$.schemas", "variant")), lambda x: made(F.concat(at, F.lit("/schemas/"), escaped(x["key"])), x["value"]))
        return F.when((e["key"] == "components") & (n["pointer"] == "#"), held).when(e["key"].isin(*SINGLE), F.array(made(at, e["value"]))).when(e["key"].isin(*MAPS), in_map).when(e["key"].isin(*LISTS), in_list).otherwise(F.array().cast(_NODES))

    return F.flatten(F.transform(_entries(n["node"]), of))


def _nesting(text: Column) -> Column:
    """How deep braces and brackets nest in a JSON text."""
    marks = F.split(F.regexp_replace(F.regexp_replace(text, r'"(\\\\.|[^"\\\\])*"', ""), r"[^{}\[\]]", ""), "")
    step = lambda a, c: F.struct((a["at"] + F.when(c.isin("{", "["), 1).when(c == "", 0).otherwise(-1)).alias("at"), F.greatest(a["most"], a["at"]).alias("most"))
    return F.aggregate(marks, F.struct(F.lit(0).alias("at"), F.lit(0).alias("most")), step, lambda a: F.greatest(a["most"], a["at"]))


#: As many levels are walked at once, in one expression; deeper documents take further passes over what lies there.
_LEVELS = 8


@cache
def _below(_application: str, d: int) -> Column:
    """The children of the nodes in column _l<d>."""
    return F.flatten(F.transform(F.col(f"_l{d}"), _children))


def _walked(df: DataFrame, ids: list[str], levels: int) -> DataFrame:
    """(ids..., pointer, node, level) of the subschemas down to `levels` below those of (ids..., pointer, node)."""
    df = df.select(*ids, F.array(F.struct("pointer", "node")).cast(_NODES).alias("_l0"))
    application = df.sparkSession.sparkContext.applicationId
    for d in range(levels):
        df = df.withColumn(f"_l{d + 1}", _below(application, d))
    with_level = lambda d: F.transform(F.col(f"_l{d}"), lambda n: F.struct(n["pointer"].alias("pointer"), n["node"].alias("node"), F.lit(d).alias("level")))
    return df.select(*ids, F.explode(F.concat(*map(with_level, range(levels + 1)))).alias("_n")).select(*ids, "_n.*")


def schema_nodes(reg: DataFrame, ids: list[str], max_depth: int | None = None) -> DataFrame:
    """(ids..., pointer, node VARIANT): every subschema, max_depth levels of them where it is given. Documents that don't
    parse give no rows. Where no text nests its braces deeper than one pass walks, there is one narrow pass; else the
    passes go on from the lowest level of the pass before, with a plan of the same size, until there is nothing below."""
    roots = reg.select(*ids, F.lit("#").alias("pointer"), F.try_parse_json("schema_json").alias("node")).filter(F.col("node").isNotNull())
    most = max_depth if max_depth is not None else max(0, (reg.agg(F.max(_nesting(F.col("schema_json")))).first()[0] or 0) - 1)
    if most <= _LEVELS:
        return _walked(roots, ids, most).drop("level")
    done, frontier = [roots], roots
    while most > 0:
        found = settle(_walked(frontier, ids, min(most, _LEVELS)).filter("level > 0"))
        done.append(found.drop("level"))
        frontier, most = found.filter(F.col("level") == min(most, _LEVELS)).drop("level"), most - _LEVELS
        if frontier.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def constraints(nodes: DataFrame, ids: list[str]) -> DataFrame:
    """(ids..., pointer, keyword, value as JSON): what the nodes say, child schemas aside."""
    rows = nodes.select(*ids, "pointer", F.explode(_entries(F.col("node"))).alias("e"))
    return rows.filter(~F.col("e.key").isin(*SINGLE, *MAPS, *LISTS)).select(*ids, "pointer", F.col("e.key").alias("keyword"), F.to_json("e.value").alias("value"))


def keyword_findings(nodes: DataFrame, ids: list[str], keywords: tuple[str, ...]) -> DataFrame:
    """(ids..., pointer, keyword) of the given keywords: warnings or hard errors."""
    rows = nodes.select(*ids, "pointer", F.explode(F.transform(_entries(F.col("node")), lambda e: e["key"])).alias("keyword"))
    return rows.filter(F.col("keyword").isin(*keywords))


def grade_warnings(old: DataFrame, new: DataFrame, ids: list[str]) -> DataFrame:
    """(ids..., warnings): what both sides of a grade are warned about, the old side's first; ids without any are left
    out. A contract's findings are bounded by its own text."""
    sides = [keyword_findings(nodes, ids, WARNED).select(*ids, F.lit(i).alias("side"), F.concat(F.lit(f"{name}: "), "pointer", F.lit(" "), "keyword").alias("text")) for i, (name, nodes) in enumerate((("old", old), ("new", new)))]
    listed = sides[0].unionByName(sides[1]).groupBy(*ids).agg(F.array_sort(F.collect_set(F.struct("side", "text"))).alias("w"))
    return listed.select(*ids, F.transform("w", lambda x: x["text"]).alias("warnings"))


def unsafe_bounds(cons: DataFrame, ids: list[str]) -> DataFrame:
    """Number bounds beyond the integers that doubles hold exactly, unless the node is integer-only."""
    types = cons.filter("keyword = 'type'").select(*ids, "pointer", F.col("value").alias("type"))
    bounds = cons.filter(F.col("keyword").isin("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum") & (F.abs(F.col("value").cast("double")) > SAFE))
    return bounds.join(types, [*ids, "pointer"], "left").filter(~F.col("type").eqNullSafe('"integer"')).drop("type")


def fractional_multiple_of(cons: DataFrame) -> DataFrame:
    v = F.col("value").cast("double")
    return cons.filter((F.col("keyword") == "multipleOf") & (v != F.floor(v)))


def ref_target(ref: Column) -> Column:
    """The pointer that a reference names, %-decoded; + stands for itself. What doesn't decode stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(ref, F.lit("+"), F.lit("%2B"))), ref)


def unresolved_refs(cons: DataFrame, nodes: DataFrame, ids: list[str]) -> DataFrame:
    """References that are not local or point at no node, and those that lead through references alone back to
    themselves (chains of up to 1,024 references are followed, by doubling)."""
    refs = cons.filter("keyword = '$ref'").withColumn("target", ref_target(F.get_json_object(F.concat(F.lit('{"r":'), "value", F.lit("}")), "$.r")))
    lost = refs.join(nodes.select(*ids, F.col("pointer").alias("target")), [*ids, "target"], "left_anti").select(*ids, "pointer", "target")
    alias = refs.join(nodes.filter(F.size(F.map_keys(F.try_variant_get("node", "$", "map<string,variant>"))) == 1).select(*ids, "pointer"), [*ids, "pointer"], "left_semi").select(*ids, "pointer", "target")
    alias = settle(alias)
    if alias.isEmpty():
        return lost
    at = alias.withColumn("now", F.col("target"))
    for _ in range(10):
        hop = at.select(*ids, F.col("pointer").alias("now"), F.col("now").alias("then"))
        at = settle(at.join(hop, [*ids, "now"], "left").select(*ids, "pointer", "target", F.coalesce("then", "now").alias("now")))
    rounds = at.join(alias.select(*ids, F.col("pointer").alias("now")), [*ids, "now"], "left_semi").select(*ids, "pointer", "target")
    return lost.unionByName(rounds)


def dialect_findings(cons: DataFrame) -> DataFrame:
    return cons.filter((F.col("keyword") == "$schema") & ~F.rtrim(F.trim(F.col("value"), F.lit('"')), F.lit("#")).isin(*DIALECTS))


def irrelevant_keywords(cons: DataFrame, ids: list[str]) -> DataFrame:
    """Constraints that say nothing because the declared type never has them."""
    of = F.create_map(*(x for t, ks in OF_TYPE.items() for k in ks for x in (F.lit(k), F.lit(t))))
    types = cons.filter("keyword = 'type'").select(*ids, "pointer", F.replace("value", F.lit("integer"), F.lit("number")).alias("type"))
    rows = cons.join(types, [*ids, "pointer"]).withColumn("_of", F.try_element_at(of, "keyword"))
    return rows.filter(F.col("_of").isNotNull() & ~F.contains("type", "_of")).select(*ids, "pointer", "keyword")


@F.pandas_udf(T.StringType())
def key_sorted(texts: pd.Series) -> pd.Series:
    """Compact JSON with sorted keys: once per schema, not per record."""

    def one(text: str | None) -> str | None:
        try:
            return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    return texts.map(one)


def canonical_hash(schema_json: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(key_sorted(schema_json), 256))


def dedupe_schemas(reg: DataFrame, id_col: str) -> DataFrame:
    """(schema_sha256, n, first_id): identical contracts across ids."""
    return reg.groupBy(canonical_hash(F.col("schema_json")).alias("schema_sha256")).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id"))


def node_table(nodes: DataFrame, ids: list[str]) -> DataFrame:
    """(ids..., pointer, n): the normalised form of every node; ids may name further columns of nodes."""
    return nodes.select(*ids, "pointer", normal_form(nodes).alias("n"))


def normal_form(nodes: DataFrame) -> Column:
    """normalised() of the columns node and pointer; large, so it is built once for an application."""
    return _normal_form(nodes.sparkSession.sparkContext.applicationId)


@cache
def _normal_form(_application: str) -> Column:
    return normalised(F.col("node"), F.col("pointer"))


def let(value: Column, body) -> Column:
    """body(x) with x evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _listed(v: Column) -> Column:
    """The values of a schema with const or enum, in canonical form; NULL for others."""
    one = F.try_variant_get(v, "$.const", "variant")
    return F.when(one.isNotNull(), F.array(Variant(one).canonical())).otherwise(F.transform(F.try_variant_get(v, "$.enum", "array<variant>"), lambda x: Variant(x).canonical()))


def _cardinality(v: Column) -> Column:
    """At most so many different values satisfy a schema; NULL where its own enum and types don't bound them."""
    get = lambda k, t: F.try_variant_get(v, f"$['{k}']", t)
    types = F.coalesce(F.when(F.schema_of_variant(F.try_variant_get(v, "$.type", "variant")) == "STRING", F.array(get("type", "string"))), get("type", "array<string>"))
    span = F.floor(F.least(get("maximum", EXACT), get("exclusiveMaximum", EXACT))) - F.ceil(F.greatest(get("minimum", EXACT), get("exclusiveMinimum", EXACT))) + 1
    of_type = lambda t: F.when(t == "boolean", 2).when(t == "null", 1).when((t == "integer") & (span < 10**9), F.greatest(span, F.lit(0)).cast("long"))
    sizes = F.transform(types, of_type)
    typed = F.when(~F.exists(sizes, lambda n: n.isNull()), F.aggregate(sizes, F.lit(0).cast("long"), lambda a, n: a + n))
    return F.least(F.size(F.array_distinct(F.transform(get("enum", "array<variant>"), lambda x: Variant(x).canonical()))).cast("long"), F.when(F.try_variant_get(v, "$.const", "variant").isNotNull(), F.lit(1).cast("long")), typed)


def with_normal_form(nodes: DataFrame, to: str) -> DataFrame:
    """nodes with normal_form() as a column, step by step: columns are compiled, lambdas interpreted."""
    first, second, third = _normal_steps(nodes.sparkSession.sparkContext.applicationId, to)
    return nodes.withColumn(to, first).withColumn(to, second).withColumn(to, third)


@cache
def _normal_steps(_application: str, to: str) -> tuple[Column, Column, Column]:
    first, second, third = _steps(F.col("node"), F.col("pointer"))
    return first, second(F.col(to)), third(F.col(to))


def normalised(node: Column, pointer: Column) -> Column:
    """Struct of what a node says itself, its combinators and references aside: type names (none: any), sorted distinct
    enum (const, types of few values and single numbers included), tightest bounds (closed for integers), counts with
    the minimums and maximums that other keywords imply, and the pointers of child schemas. tags: the values of properties that
    list them; never: properties that no value may have; free: those that are not constrained; opaque: says things that no rule judges."""
    first, second, third = _steps(node, pointer)
    return let(let(first, second), third)


def _steps(node: Column, pointer: Column) -> tuple[Column, Callable[[Column], Column], Callable[[Column], Column]]:
    """What normalised() takes from a node, and the two steps that follow."""
    n = Variant(node)
    raw = lambda k: F.try_variant_get(node, f"$['{k}']", "variant")
    get = lambda k, t: F.try_variant_get(node, f"$['{k}']", t)
    whole_count = lambda k: F.when(Variant(raw(k)).is_type("integer"), get(k, "long"))
    keys = F.coalesce(n.keys(), F.array().cast("array<string>"))
    at = lambda k: F.concat(pointer, F.lit(f"/{k}"))
    has = lambda k: F.array_contains(keys, k)
    trivial = lambda v: F.to_json(v).isin("true", "{}")
    none = F.array().cast("array<string>")
    listed = F.coalesce(F.when(F.schema_of_variant(raw("type")) == "STRING", F.array(get("type", "string"))), get("type", "array<string>"))
    step = get("multipleOf", EXACT)
    listed = F.when((step % 1 == 0) & F.array_contains(listed, "number"), F.array_distinct(F.transform(listed, lambda t: F.when(t == "number", "integer").otherwise(t)))).otherwise(listed)
    listed = F.when(F.array_contains(listed, "number"), F.array_remove(listed, "integer")).otherwise(listed)
    values = F.coalesce(F.when(has("const"), F.array(raw("const"))), get("enum", "array<variant>"))
    values = F.when(has("const") & has("enum"), F.filter(get("enum", "array<variant>"), lambda v: Variant(v).canonical() == Variant(raw("const")).canonical())).otherwise(values)
    enum = F.array_sort(F.array_distinct(F.transform(values, lambda v: Variant(v).canonical())))
    low, low_x, high, high_x = (get(k, EXACT) for k in ("minimum", "exclusiveMinimum", "maximum", "exclusiveMaximum"))
    bounds = ("minimum", "exclusiveMinimum", "maximum", "exclusiveMaximum", "multipleOf")
    odd = reduce(lambda a, b: a | b, ((has(k) & ~F.coalesce(get(k, EXACT).cast("double") == get(k, "double"), F.lit(False))) for k in bounds))
    objects = F.coalesce(get("properties", "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    patterns = F.coalesce(get("patternProperties", "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    pointers = lambda m, k: F.transform_values(m, lambda name, _: F.concat(at(k), F.lit("/"), escaped(name)))
    rest, items = F.to_json(raw("additionalProperties")), F.to_json(raw("items"))
    unique = F.coalesce(get("uniqueItems", "boolean"), F.lit(False))
    required = F.array_sort(F.array_distinct(F.coalesce(get("required", "array<string>"), none)))
    prefix = F.coalesce(F.transform(get("prefixItems", "array<variant>"), lambda _, i: F.concat(at("prefixItems"), F.lit("/"), i.cast("string"))), none)
    deps = F.coalesce(get("dependentRequired", "map<string,array<string>>"), F.from_json(F.lit("{}"), "map<string,array<string>>"))
    narrow = lambda k, text: F.when(text.isNotNull() & ~text.isin("true", "false", "{}"), at(k))
    first = F.struct(
        listed.alias("types"), enum.alias("enum"), low.alias("low"), low_x.alias("low_x"), high.alias("high"), high_x.alias("high_x"), step.alias("step"), F.to_json(node).alias("text"), objects.alias("objects"),
        required.alias("required"), prefix.alias("prefix"), (F.coalesce(rest == "false", F.lit(False))).alias("shut"), F.coalesce(items == "false", F.lit(False)).alias("no_items"),
        whole_count("minContains").alias("min_contains"), has("contains").alias("contains"), F.map_filter(F.transform_values(objects, lambda _, v: _listed(v)), lambda _, xs: xs.isNotNull()).alias("tags"), F.size(patterns).alias("n_patterns"), F.when(unique & ~has("prefixItems"), _cardinality(raw("items"))).alias("different"),
    )

    def second(x: Column) -> Column:
        whole = F.coalesce(F.array_contains(x["types"], "integer") & ~F.array_contains(x["types"], "number"), F.lit(False))
        lo, hi = F.greatest(x["low"], x["low_x"]), F.least(x["high"], x["high_x"])
        lo_open, hi_open = F.coalesce(lo == x["low_x"], F.lit(False)), F.coalesce(hi == x["high_x"], F.lit(False))
        up, down = F.ceil(lo).cast(EXACT), F.floor(hi).cast(EXACT)
        lo_closed = F.when(whole, (up + (lo_open & (lo == up)).cast("int")).cast(EXACT)).otherwise(lo)
        hi_closed = F.when(whole, (down - (hi_open & (hi == down)).cast("int")).cast(EXACT)).otherwise(hi)
        never = F.map_keys(F.map_filter(x["objects"], lambda _, v: F.to_json(v) == "false"))
        props = F.array_except(F.map_keys(x["objects"]), never)
        often = F.get(F.filter(F.array(*map(F.lit, _SHARES)), lambda k: (x["step"] * k) % 1 == 0), F.lit(0))  # so many steps are whole
        step = F.when(whole, F.nullif(x["step"] * often, F.lit(1))).otherwise(x["step"])
        closed = x["shut"] & (x["n_patterns"] == 0)
        cols = {
            "text": x["text"], "types": x["types"], "enum": x["enum"], "lo": lo_closed, "lo_open": lo_open & ~whole, "hi": hi_closed, "hi_open": hi_open & ~whole, "step": step.cast(EXACT), "whole": whole,
            "min_len": whole_count("minLength"), "max_len": whole_count("maxLength"), "pattern": get("pattern", "string"),
            "min_items": F.greatest(whole_count("minItems"), F.when(x["contains"], F.coalesce(x["min_contains"], F.lit(1)))), "max_items": F.least(whole_count("maxItems"), F.when(x["no_items"], F.size(x["prefix"]).cast("long")), x["different"]), "uniq": unique,
            "props": props, "never": never, "free": F.map_keys(F.map_filter(x["objects"], lambda _, v: trivial(v))), "required": x["required"], "closed": closed, "shut": x["shut"], "deps": deps,
            "tags": x["tags"], "at_props": pointers(x["objects"], "properties"), "at_pats": pointers(patterns, "patternProperties"), "at_rest": narrow("additionalProperties", rest), "at_names": narrow("propertyNames", F.to_json(raw("propertyNames"))), "names": F.to_json(raw("propertyNames")), "name_list": F.try_variant_get(raw("propertyNames"), "$.enum", "array<string>"),
            "at_items": narrow("items", items), "at_prefix": x["prefix"], "at_contains": F.when(x["contains"], at("contains")), "contains": F.to_json(raw("contains")),
            "min_contains": F.coalesce(x["min_contains"], F.lit(1)), "max_contains": whole_count("maxContains"),
            "odd": odd | (whole & x["step"].isNotNull() & often.isNull()), "opaque": odd | F.arrays_overlap(keys, F.array(*map(F.lit, ("dependentSchemas", "unevaluatedProperties", "unevaluatedItems", "$dynamicRef")))) | (whole & x["step"].isNotNull() & often.isNull()),
            "odd_pats": F.exists(F.map_keys(patterns), lambda p: ~p.rlike(SAFE_PATTERN)),
            "min_props": F.greatest(whole_count("minProperties"), F.size(x["required"]).cast("long")), "max_props": F.least(whole_count("maxProperties"), F.when(closed, F.size(props).cast("long"))),
        }
        return F.struct(*(c.alias(k) for k, c in cols.items()))

    def third(x: Column) -> Column:
        """Few values are written as an enum."""
        kinds = lambda *ts: F.size(x["types"]) == F.size(F.array_intersect(x["types"], F.array(*map(F.lit, ts))))
        few = F.when(kinds("boolean", "null"), F.array_sort(F.flatten(F.transform(x["types"], lambda t: F.when(t == "null", F.array(F.lit("null"))).otherwise(F.array(F.lit("false"), F.lit("true")))))))
        one = F.when(kinds("integer", "number") & (x["lo"] == x["hi"]) & ~x["lo_open"] & ~x["hi_open"] & (x["lo"] % 1 == 0), F.array(x["lo"].cast("decimal(20,0)").cast("string")))
        return x.withField("enum", F.coalesce(x["enum"], few, one))

    return first, second, third
