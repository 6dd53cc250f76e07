"""Backward compatibility of contract versions, by joins over tables of schema nodes.

Serializer: what the new version writes must be readable by the old one (new within old). Deserializer: what the old
version wrote must be readable by the new one (old within new), over values without undeclared keys. Both: and.
A verdict is compatible, incompatible or unknown; what the rules don't decide is unknown, never compatible.

Contracts whose nodes only stand in properties and items meet at equal pointers, in one grouping. For those with
references, combinators, conditionals, patterns or the like, goals "this node of one version within that node of the
other" are expanded level by level: each goal is a conjunction of clauses, each clause a choice of sets of further
goals. Equal goals are one, so recursive contracts end; then values are lowered until nothing changes. A clause whose
choices all fail says incompatible only where the split into choices is exact, unknown otherwise.
"""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlake.functions.settled import settle, spread
from pactlake.functions.values import EXACT, Variant

from .registry_scan import HARD, SAFE_PATTERN, canonical_hash, constraints, dialect_findings, keyword_findings, let, node_table, normal_form, ref_target, schema_nodes, unresolved_refs

_ISSUE = "array<struct<rank:int,keyword:string,message:string>>"


def pair_versions(reg: DataFrame, id_col: str = "stable_id", version_col: str = "version", payload: str = "schema_json") -> DataFrame:
    """(id, version, old, new) of consecutive versions."""
    w = Window.partitionBy(id_col).orderBy(version_col)
    return reg.select(id_col, version_col, F.lag(payload).over(w).alias("old"), F.col(payload).alias("new")).filter(F.col("old").isNotNull())


def directions(role: Column) -> Column:
    """The direction rows of a role."""
    both = F.array(F.lit("serializer"), F.lit("deserializer"))
    return F.explode(F.when(role == "both", both).otherwise(F.array(role)))


#: Contracts with these go by goals, others by equal pointers.
_RICH = r'"(\$ref|allOf|anyOf|oneOf|not|if|patternProperties|propertyNames|contains|prefixItems|dependentSchemas|unevaluated[A-Z][a-z]+|\$dynamicRef)"\s*:|"additionalProperties"\s*:\s*\{'
#: Pointers that contracts without those leave to the rules on their parents.
_APART = r"(?<!/properties)/(additionalProperties|items)$|/(\$defs|definitions)/"
_TYPES = ("null", "boolean", "integer", "number", "string", "array", "object")
_STRINGS = "array<string>"


def _kind(value: Column) -> Column:
    """The type name of a value given as JSON text."""
    first = F.substr(value, F.lit(1), F.lit(1))
    other = F.when(value.try_cast(EXACT) % 1 == 0, "integer").when(value.try_cast(EXACT).isNull() & (value.try_cast("double") % 1 == 0), "integer").otherwise("number")
    return F.when(first == '"', "string").when(first == "{", "object").when(first == "[", "array").when(value == "null", "null").when(value.isin("true", "false"), "boolean").otherwise(other)


def _has(node: Column, *kinds: str) -> Column:
    """Whether values of one of the types may be among the node's."""
    named = F.array(*map(F.lit, {*kinds, *(["number"] if "integer" in kinds else [])}))
    return F.coalesce(F.arrays_overlap(node["types"], named), F.lit(True))


def _fits(value: Column, node: Column, among: bool = True) -> Column:
    """Whether a node takes a value given as JSON text; NULL where its own keywords can't be tried on it. With among, the
    node's enum counts too."""
    holds = lambda c: F.coalesce(c, F.lit(True))
    kind, number = _kind(value), value.try_cast(EXACT)
    text = F.get_json_object(F.concat(F.lit("["), value, F.lit("]")), "$[0]")
    length = F.length(text)
    typed = holds(F.array_contains(node["types"], kind) | ((kind == "integer") & F.array_contains(node["types"], "number")))
    low, high = (number > node["lo"]) | ((number == node["lo"]) & ~node["lo_open"]), (number < node["hi"]) | ((number == node["hi"]) & ~node["hi_open"])
    bounded = node["lo"].isNotNull() | node["hi"].isNotNull() | node["step"].isNotNull()
    numeric = F.when(number.isNull() & bounded, F.lit(None).cast("boolean")).otherwise(holds(low) & holds(high) & holds(number % node["step"] == 0))
    pattern = node["pattern"]
    matched = F.when(pattern.isNull(), True).when(pattern.rlike(SAFE_PATTERN), _like(text, pattern))
    lengths = holds(length >= node["min_len"]) & holds(length <= node["max_len"]) & matched
    array_says = node["at_items"].isNotNull() | (F.size(node["at_prefix"]) > 0) | node["at_contains"].isNotNull() | node["min_items"].isNotNull() | node["max_items"].isNotNull() | node["uniq"]
    object_says = (F.size(node["at_props"]) > 0) | (F.size(node["at_pats"]) > 0) | node["at_rest"].isNotNull() | node["at_names"].isNotNull() | node["shut"] | (F.size(node["required"]) > 0) | (F.size(node["deps"]) > 0) | F.coalesce(node["min_props"] > 0, F.lit(False)) | node["max_props"].isNotNull()
    own = F.when(kind.isin("integer", "number"), numeric).when(kind == "string", lengths)
    own = own.when((kind == "array") & array_says, F.lit(None).cast("boolean")).when((kind == "object") & object_says, F.lit(None).cast("boolean")).otherwise(True)
    listed = holds(F.array_contains(node["enum"], value)) if among else F.lit(True)
    return (node["text"] != "false") & typed & listed & F.when(node["opaque"] & kind.isin("object", "array"), F.lit(None).cast("boolean")).otherwise(own)


def _like(text: Column, pattern: Column) -> Column:
    """Whether a pattern of the safe kind occurs in the text; false for other patterns."""
    return F.when(pattern.rlike(SAFE_PATTERN), F.regexp_like(text, F.replace(pattern, F.lit("$"), F.lit(r"\z")))).otherwise(False)


#: So many values of a type are tried one by one.
_FEW = 256


def _few_values(n: Column) -> Column:
    """All values that a node without enum can have, as JSON texts, if its types have few: null, booleans, and integers
    between close bounds; else NULL."""
    step = F.coalesce(n["step"], F.lit(1).cast(EXACT))
    first, last = F.ceil(n["lo"] / step), F.floor(n["hi"] / step)
    whole = F.when(last < first, F.array().cast(_STRINGS)).when(last - first < _FEW, F.transform(F.sequence(first.cast("long"), last.cast("long")), lambda i: (i * step).cast("decimal(38,0)").cast("string")))
    of_type = lambda t: F.when(t == "null", F.array(F.lit("null"))).when(t == "boolean", F.array(F.lit("false"), F.lit("true"))).when((t == "integer") & ~n["odd"], whole)
    return F.when(n["enum"].isNull() & (F.size(n["types"]) > 0), let(F.transform(n["types"], of_type), lambda xs: F.when(~F.exists(xs, lambda x: x.isNull()), F.flatten(xs))))


def _closure(names: Column, deps: Column) -> Column:
    """The names that are there whenever the given ones are; after as many steps as there are triggers nothing changes."""
    more = lambda acc: F.flatten(F.map_values(F.map_filter(deps, lambda k, _: F.array_contains(acc, k))))
    return F.when(F.size(deps) == 0, names).otherwise(F.aggregate(F.map_keys(deps), names, lambda acc, _: F.array_union(acc, more(acc))))


def _no_value(n: Column, held: Column) -> Column:
    """Whether a node certainly accepts nothing."""
    c = lambda x: F.coalesce(x, F.lit(False))
    only = lambda *ts: c((F.size(n["types"]) > 0) & (F.size(F.array_except(n["types"], F.array(*map(F.lit, ts)))) == 0))
    crossed = c(n["lo"] > n["hi"]) | c((n["lo"] == n["hi"]) & (n["lo_open"] | n["hi_open"]))
    never = c(n["min_props"] > n["max_props"]) | F.arrays_overlap(held, n["never"])
    listed = c(F.forall(n["enum"], lambda v: ~F.coalesce(_fits(v, n, False), F.lit(True))))
    return (n["text"] == "false") | listed | (only("number", "integer") & crossed) | (only("string") & c(n["min_len"] > n["max_len"])) | (only("object") & never) | (only("array") & c(n["min_items"] > n["max_items"]))


def _issues(raw: Column, sub: Column, sup: Column) -> Column:
    """The violated rules of one pair of nodes, in order of explanation; raw: undeclared properties count too."""
    return let(_closure(sub["required"], sub["deps"]), lambda held: _rules(raw, sub, sup, held))


@cache
def _met_issues(_application: str) -> Column:
    return _issues(F.col("direction") == "serializer", F.col("sub"), F.col("sup"))


def _span(lo: Column, hi: Column) -> Column:
    """A range as text, an end without bound as ..."""
    plain = lambda c: F.coalesce(F.regexp_replace(c.cast("string"), r"(\.[0-9]*?)0+$", "$1"), F.lit(".."))
    return F.concat(F.lit("["), F.regexp_replace(plain(lo), r"\.$", ""), F.lit(", "), F.regexp_replace(plain(hi), r"\.$", ""), F.lit("]"))


def _rules(raw: Column, sub: Column, sup: Column, held: Column) -> Column:
    n = lambda c: F.coalesce(c, F.lit(False))
    says = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    below = lambda a, b: b.isNotNull() & (a.isNull() | (a < b))
    above = lambda a, b: b.isNotNull() & (a.isNull() | (a > b))
    free, listed = sub["enum"].isNull(), sub["enum"].isNotNull()
    obj, arr, text, number = (free & _has(sub, *k) for k in (("object",), ("array",), ("string",), ("integer", "number")))
    missing = F.array_except(sup["required"], held)
    needs = F.flatten(F.transform(F.map_entries(sup["deps"]), lambda e: F.transform(F.array_except(e["value"], _closure(F.array_append(held, e["key"]), sub["deps"])), lambda d: F.struct(e["key"].alias("trigger"), d.alias("name")))))
    needs = F.filter(needs, lambda d: ~F.array_contains(sub["never"], d["trigger"]) & (~sub["closed"] | F.array_contains(sub["props"], d["trigger"])))
    wide = lambda x: F.when(F.array_contains(x["types"], "number"), F.array_append(x["types"], F.lit("integer"))).otherwise(x["types"])
    gone = F.array_except(F.coalesce(sub["types"], F.array(*map(F.lit, _TYPES))), wide(sup))
    declared = lambda x: F.map_keys(x["at_props"])
    under_pattern = lambda name: F.exists(F.map_keys(sup["at_pats"]), lambda p: _like(name, p))
    only_sub = F.filter(F.array_except(sub["props"], declared(sup)), lambda k: (F.size(sup["at_pats"]) == 0) | ~under_pattern(k))
    only_sup = F.array_except(F.array_except(declared(sup), sup["free"]), declared(sub))
    tried = F.transform(sub["enum"], lambda v: F.struct(v.alias("v"), _fits(v, sub, False).alias("live"), _fits(v, sup).alias("ok")))
    rejected = F.filter(tried, lambda t: n(t["live"]) & n(~t["ok"]))
    unseen = F.exists(tried, lambda t: F.coalesce(t["live"], F.lit(True)) & (t["ok"].isNull() | (t["live"].isNull() & ~t["ok"])))
    few = F.when(sup["enum"].isNotNull(), _few_values(sub))
    strays = F.filter(few, lambda v: ~F.array_contains(sup["enum"], v))
    low = below(sub["lo"], sup["lo"]) | ((sub["lo"] == sup["lo"]) & sup["lo_open"] & ~sub["lo_open"])
    high = above(sub["hi"], sup["hi"]) | ((sub["hi"] == sup["hi"]) & sup["hi_open"] & ~sub["hi_open"])
    step = F.coalesce(sub["step"], F.when(sub["whole"], F.lit(1).cast(EXACT)))
    same_contained = sub["contains"] == sup["contains"]
    first = lambda a: F.get(a, F.lit(0))
    ends = lambda what, a, b: says(what, " ", _span(sub[a], sub[b]), " not contained by required ", what, " ", _span(sup[a], sup[b]))
    rules = [
        ("false", sup["text"] == "false", says("no value is accepted")),
        ("required", obj & (F.size(missing) > 0), says("property '", first(missing), "' is no longer guaranteed to be present")),
        ("type", sup["types"].isNotNull() & free & (F.size(gone) > 0), says("type ", first(gone), " is not among ", F.array_join(sup["types"], ", "))),
        ("enum", listed & (F.size(rejected) > 0), says("value ", first(rejected)["v"], " is no longer accepted")),
        ("enum", free & (F.size(strays) > 0), says("value ", first(strays), " is no longer accepted")),
        ("enum", free & sup["enum"].isNotNull() & few.isNull(), says("values beyond ", F.array_join(sup["enum"], ", "), " are possible")),
        ("minimum", number & low, ends("bounds", "lo", "hi")),
        ("maximum", number & high, ends("bounds", "lo", "hi")),
        ("multipleOf", number & sup["step"].isNotNull() & ~n(step % sup["step"] == 0), says("steps of ", F.coalesce(step.cast("double").cast("string"), F.lit("any size")), " are no multiples of ", sup["step"].cast("double").cast("string"))),
        ("minLength", text & below(sub["min_len"], sup["min_len"]) & (sup["min_len"] > 0), ends("lengths", "min_len", "max_len")),
        ("maxLength", text & above(sub["max_len"], sup["max_len"]), ends("lengths", "min_len", "max_len")),
        ("pattern", text & sup["pattern"].isNotNull() & ~sub["pattern"].eqNullSafe(sup["pattern"]), says("pattern ", sup["pattern"], " is not kept")),
        ("properties", obj & sup["shut"] & (F.size(only_sub) > 0), says("declared property '", first(only_sub), "' is not accepted")),
        ("properties", obj & raw & ~sub["shut"] & sub["at_rest"].isNull() & (F.size(sub["at_pats"]) == 0) & sub["at_names"].isNull() & (F.size(only_sup) > 0), says("undeclared property '", first(only_sup), "' may not fit")),
        ("additionalProperties", obj & sup["shut"] & ~sub["shut"] & (raw | (F.size(sup["at_pats"]) == 0)), says("additional properties are not accepted")),
        ("dependentRequired", obj & (F.size(needs) > 0), says("property '", first(needs)["name"], "' no longer comes with '", first(needs)["trigger"], "'")),
        ("contains", arr & same_contained & ((sub["min_contains"] < sup["min_contains"]) | above(sub["max_contains"], sup["max_contains"])), says("fewer or more contained items are possible")),
        ("items", arr & sup["at_items"].isNotNull() & sub["at_items"].isNull() & (F.size(sub["at_prefix"]) == 0) & ~n(sub["max_items"] <= F.size(sup["at_prefix"])), says("items are not constrained")),
        ("additionalProperties", obj & raw & sup["at_rest"].isNotNull() & sub["at_rest"].isNull() & ~sub["shut"], says("additional properties are not constrained")),
        ("minProperties", obj & below(sub["min_props"], sup["min_props"]) & (sup["min_props"] > F.size(sup["required"])), ends("property counts", "min_props", "max_props")),
        ("maxProperties", obj & above(sub["max_props"], sup["max_props"]), ends("property counts", "min_props", "max_props")),
        ("minItems", arr & below(sub["min_items"], sup["min_items"]) & (sup["min_items"] > 0) & ~n(same_contained & (sup["min_items"] <= sup["min_contains"])), ends("item counts", "min_items", "max_items")),
        ("maxItems", arr & above(sub["max_items"], sup["max_items"]), ends("item counts", "min_items", "max_items")),
        ("uniqueItems", arr & sup["uniq"] & ~sub["uniq"] & ~n(sub["max_items"] <= 1), says("items may repeat")),
    ]
    told = [F.when(n(test), F.struct(F.lit(i).alias("rank"), F.lit(k).alias("keyword"), m.alias("message"))) for i, (k, test, m) in enumerate(rules)]
    # What sub says besides only makes it smaller; a broken rule proves nothing then.
    unknown = F.when(n(unseen) | sup["opaque"] | sup["odd_pats"] | sub["odd_pats"], F.struct(F.lit(99).alias("rank"), F.lit("unknown").alias("keyword"), F.lit("outside the compared fragment").alias("message")))
    settled = ((sub["text"] == sup["text"]) & ~F.contains(sub["text"], F.lit('"$ref"'))) | _no_value(sub, held)
    return F.when(settled, F.array().cast(_ISSUE)).otherwise(let(F.array_compact(F.array(*told, unknown)).cast(_ISSUE), lambda found: F.when(sub["opaque"], F.transform(found, lambda i: i.withField("keyword", F.lit("unknown")).withField("rank", F.lit(99)))).otherwise(found)))


def node_issues(nodes: DataFrame, pairs: DataFrame, pair: list[str]) -> DataFrame:
    """nodes: (pair..., side 'old' or 'new', pointer, n), pairs: (pair..., role). Rows (pair..., direction, pointer,
    keyword, message, rank) of violated rules; nodes that one side lacks are judged at their parents."""
    met = spread(nodes, *pair, "pointer").groupBy(*pair, "pointer").agg(F.max_by("n", F.when(F.col("side") == "old", 1)).alias("o"), F.max_by("n", F.when(F.col("side") == "new", 1)).alias("w"))
    met = met.filter(F.col("o.text") != F.col("w.text")).join(pairs.select(*pair, "role"), pair).withColumn("direction", directions(F.col("role")))
    forth = F.col("direction") == "serializer"
    met = met.select(*pair, "direction", "pointer", F.when(forth, F.col("w")).otherwise(F.col("o")).alias("sub"), F.when(forth, F.col("o")).otherwise(F.col("w")).alias("sup"))
    met = met.filter(~F.col("pointer").rlike(_APART) | F.col("pointer").rlike(r"/items$") & F.col("sub.text").startswith("{") & F.col("sup.text").startswith("{"))
    found = met.select(*pair, "direction", "pointer", F.explode(_met_issues(nodes.sparkSession.sparkContext.applicationId)).alias("i"))
    return found.select(*pair, "direction", "pointer", "i.keyword", "i.message", "i.rank")


def verdicts(pairs: DataFrame, issues: DataFrame, pair: list[str]) -> DataFrame:
    """(pair..., direction, verdict, pointer, keyword, message): the first reason, nearest to the root, by rule."""
    order = F.struct((F.size(F.split("pointer", "/"))).alias("depth"), "rank", "pointer", "keyword", "message")
    first = issues.groupBy(*pair, "direction").agg(F.min(order).alias("i"), F.max(F.col("keyword") != "unknown").alias("broken"))
    rows = pairs.select(*pair, directions(F.col("role")).alias("direction")).join(first, [*pair, "direction"], "left")
    verdict = F.when(F.col("broken"), "incompatible").when(F.col("i").isNotNull(), "unknown").otherwise("compatible")
    return rows.select(*pair, "direction", verdict.alias("verdict"), "i.pointer", "i.keyword", "i.message")


def graph(docs: DataFrame, ids: list[str]) -> DataFrame:
    """(ids..., pointer, kind, n, kids, say, text, types) of documents (ids..., schema_json): nodes by what they are.

    plain: what the node itself says, in n. all, any, one: combinators of the nodes at kids. not: of the first kid, whose
    own form is n. if: of kids condition, then, else, with the condition's text in say. A node that both says something
    and combines is an `all` of parts named pointer!kind. pointer!t and pointer!e are shares of a plain node: one for
    each of its types, or each of its values; pointer!names are the names of its properties; true accepts everything.
    types: the types that values may have, NULL for any."""
    nodes = schema_nodes(docs, ids)
    v = F.col("node")
    keys = F.coalesce(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), F.array().cast(_STRINGS))
    strings = lambda *xs: F.array(*xs).cast(_STRINGS)
    branches = lambda k: F.coalesce(F.transform(F.try_variant_get(v, f"$['{k}']", "array<variant>"), lambda _, i: F.concat("pointer", F.lit(f"/{k}/"), i.cast("string"))), strings())
    child = lambda k: F.when(F.array_contains(keys, k), F.concat("pointer", F.lit(f"/{k}"))).otherwise(F.lit("true"))
    has = lambda k: F.array_contains(keys, k)
    combining = ("allOf", "anyOf", "oneOf", "not", "if", "then", "else", "$ref", "$defs", "definitions", "components", "$schema", "title", "description", "$comment", "default", "examples", "deprecated", "readOnly", "writeOnly", "format")
    says = F.size(F.array_except(keys, F.array(*map(F.lit, combining)))) > 0
    mixed = F.arrays_overlap(keys, F.array(*map(F.lit, ("allOf", "anyOf", "oneOf", "not", "if", "$ref"))))
    part = lambda name: F.concat("pointer", F.lit(f"!{name}"))
    made = lambda pointer, kind, kids, say=None, of=None: F.struct(pointer.alias("pointer"), F.lit(kind).alias("kind"), kids.alias("kids"), (say if say is not None else F.lit(None).cast("string")).alias("say"), (of if of is not None else F.lit(None).cast("variant")).alias("of"))
    conditional = has("if") & (has("then") | has("else"))
    kids = F.flatten(F.array(
        F.when(says, strings(part("plain"))).otherwise(strings()), branches("allOf"), F.when(has("anyOf"), strings(part("any"))).otherwise(strings()), F.when(has("oneOf"), strings(part("one"))).otherwise(strings()),
        F.when(has("not"), strings(part("not"))).otherwise(strings()), F.when(conditional, strings(part("if"))).otherwise(strings()), F.when(has("$ref"), strings(ref_target(F.try_variant_get(v, "$['$ref']", "string")))).otherwise(strings()),
    ))
    own = F.when(mixed, made(F.col("pointer"), "all", kids)).otherwise(made(F.col("pointer"), "plain", strings(), of=v))
    split = F.array_compact(F.array(
        own, F.when(mixed & says, made(part("plain"), "plain", strings(), of=v)), F.when(has("anyOf"), made(part("any"), "any", branches("anyOf"))), F.when(has("oneOf"), made(part("one"), "one", branches("oneOf"))),
    ))
    # Of each branch of a oneOf what it must not be for another one to count.
    apart_from = F.coalesce(F.transform(F.try_variant_get(v, "$['oneOf']", "array<variant>"), lambda b, i: made(F.concat("pointer", F.lit("/oneOf/"), i.cast("string"), F.lit("!no")), "not", strings(F.concat("pointer", F.lit("/oneOf/"), i.cast("string"))), of=b)), F.array().cast("array<struct<pointer:string,kind:string,kids:array<string>,say:string,of:variant>>"))
    split = F.concat(split, apart_from, F.array_compact(F.array(
        F.when(has("not"), made(part("not"), "not", strings(child("not")), of=F.try_variant_get(v, "$['not']", "variant"))),
        F.when(conditional, made(part("if"), "if", strings(child("if"), child("then"), child("else")), F.to_json(F.try_variant_get(v, "$['if']", "variant")))),
    )))
    rows = nodes.select(*ids, F.col("pointer").alias("_base"), F.to_json("node").alias("text"), F.explode(split).alias("p"))
    rows = rows.unionByName(docs.select(*ids, F.lit("true").alias("_base"), F.lit("true").alias("text"), made(F.lit("true"), "plain", strings(), of=F.parse_json(F.lit("true"))).alias("p")))
    rows = rows.select(*ids, F.col("p.pointer").alias("_name"), "p.kind", "p.kids", "p.say", "text", F.col("p.of").alias("node"), F.when(F.col("p.kind") == "not", F.concat("_base", F.lit("/not"))).otherwise(F.col("_base")).alias("pointer"))
    rows = rows.withColumn("n", F.when(F.col("node").isNotNull(), normal_form(rows))).select(*ids, F.col("_name").alias("pointer"), "kind", "n", "kids", "say", "text")

    def shares(n: Column, pointer: Column) -> Column:
        row = lambda name, kind, n, kids=strings(): F.struct(F.concat(pointer, F.lit("!"), name).alias("pointer"), F.lit(kind).alias("kind"), n.alias("n"), kids.alias("kids"))
        by_type = F.when(n["enum"].isNull() & (F.size(n["types"]) > 1), F.transform(n["types"], lambda t: row(F.concat(F.lit("t"), t), "plain", n.withField("types", F.array(t)).withField("enum", F.when(t == "null", F.array(F.lit("null"))).when(t == "boolean", F.array(F.lit("false"), F.lit("true")))).withField("text", F.concat(n["text"], t)))))
        by_value = F.when(F.size(n["enum"]) > 1, F.transform(n["enum"], lambda x: row(F.concat(F.lit("e"), x), "plain", n.withField("enum", F.array(x)).withField("text", F.concat(n["text"], x)))))
        quoted = F.transform(F.map_keys(n["at_props"]), lambda k: F.regexp_replace(F.to_json(F.struct(k.alias("k"))), r'^\{"k":|\}$', ""))
        texts = n.withField("enum", F.array_sort(quoted)).withField("text", F.concat(n["text"], F.lit("names"))).withField("types", F.array(F.lit("string")))
        for k in ("min_len", "max_len"):
            texts = texts.withField(k, F.lit(None).cast("long"))
        for k, v in (("pattern", F.lit(None).cast("string")), ("opaque", F.lit(False)), ("odd_pats", F.lit(False))):
            texts = texts.withField(k, v)
        named = F.when(F.size(n["at_props"]) > 0, F.array(row(F.lit("names"), "plain", texts)))
        return F.flatten(F.array_compact(F.array(by_type, by_value, named)))

    plain = rows.filter("kind = 'plain'")
    shared = plain.select(*ids, F.explode(shares(F.col("n"), F.col("pointer"))).alias("s")).select(*ids, "s.pointer", "s.kind", "s.n", "s.kids", F.lit(None).cast("string").alias("say"), F.col("s.n.text").alias("text"))
    table = settle(rows.unionByName(shared).withColumn("types", F.when((F.col("kind") == "plain") & (F.col("n.text") != "true"), F.coalesce(F.transform("n.enum", _kind), F.col("n.types")))))
    widened = lambda t: F.when(F.array_contains(t, "number"), F.array_union(t, strings(F.lit("integer"), F.lit("number")))).otherwise(t)
    for _ in range(2):  # types of combinators, two levels of them deep; deeper ones may have any
        deals = table.filter("kind IN ('all', 'any', 'one')").select(*ids, "pointer", "kind", F.explode("kids").alias("kid"))
        found = deals.join(table.select(*ids, F.col("pointer").alias("kid"), widened(F.col("types")).alias("kt")), [*ids, "kid"], "left").groupBy(*ids, "pointer", "kind").agg(F.collect_list("kt").alias("lists"), F.count("*").alias("n"))
        both = F.when(F.size("lists") > 0, F.aggregate("lists", F.array(*map(F.lit, _TYPES)), F.array_intersect))
        either = F.when(F.size("lists") == F.col("n"), F.array_distinct(F.flatten("lists")))
        table = table.join(found.select(*ids, "pointer", F.when(F.col("kind") == "all", both).otherwise(either).alias("_t")), [*ids, "pointer"], "left").withColumn("types", F.coalesce("types", "_t")).drop("_t")
    if not docs.filter(F.contains("schema_json", F.lit('"$ref"'))).isEmpty():
        links = table.filter("kind <> 'plain'").select(*ids, "pointer", F.explode("kids").alias("kid"))
        links = settle(links.join(table.filter("kind <> 'plain'").select(*ids, F.col("pointer").alias("kid")), [*ids, "kid"], "left_semi").select(*ids, "pointer", "kid"))
        for _ in range(3):  # what combines itself again within 8 steps, without a property or item between, says nothing
            links = settle(links.unionByName(links.join(links.select(*ids, F.col("pointer").alias("kid"), F.col("kid").alias("next")), [*ids, "kid"]).select(*ids, "pointer", F.col("next").alias("kid"))).distinct())
        loops = links.filter("pointer = kid").select(*ids, "pointer", F.lit(True).alias("_loop"))
        table = table.join(loops, [*ids, "pointer"], "left").withColumn("kind", F.when(F.col("_loop").isNull(), F.col("kind"))).drop("_loop")
    table = settle(table)
    # Alternatives that are nothing but ranges of numbers, for the cover of a range by several of them.
    single = F.coalesce((F.size("n.enum") == 1) & (F.col("n.lo") == F.col("n.hi")) & F.array_contains("n.enum", F.col("n.lo").cast("decimal(20,0)").cast("string")), F.lit(False))
    ranged = (F.col("kind") == "plain") & (F.col("n.enum").isNull() | single) & F.col("n.step").isNull() & ~F.col("n.opaque")
    own_range = F.when(ranged, F.struct(F.coalesce("n.lo", F.lit("-" + _FAR).cast(EXACT)).alias("lo"), F.col("n.lo_open"), F.coalesce("n.hi", F.lit(_FAR).cast(EXACT)).alias("hi"), F.col("n.hi_open"), F.coalesce("n.whole", F.lit(False)).alias("whole")))
    kid_types = table.filter("kind IN ('any', 'one')").select(*ids, "pointer", F.posexplode("kids").alias("i", "kid")).join(table.select(*ids, F.col("pointer").alias("kid"), F.coalesce(widened(F.col("types")), F.array(*map(F.lit, _TYPES))).alias("kt"), own_range.alias("r")), [*ids, "kid"])
    kid_types = kid_types.groupBy(*ids, "pointer").agg(F.array_sort(F.collect_list(F.struct("i", "kt", "r"))).alias("_kids")).select(*ids, "pointer", F.transform("_kids", lambda x: x["kt"]).alias("kid_types"), F.transform("_kids", lambda x: x["r"]).alias("kid_ranges"))
    merged = table.filter("kind = 'all'").select(*ids, "pointer", F.explode("kids").alias("kid")).join(table.filter("kind = 'plain' AND n.enum IS NULL").select(*ids, F.col("pointer").alias("kid"), "n"), [*ids, "kid"])
    merged = merged.groupBy(*ids, "pointer").agg(F.collect_list("n").alias("ns")).filter(F.size("ns") > 1)
    merged = merged.join(table.select(*ids, "pointer", "kids"), [*ids, "pointer"]).withColumn("ns", F.when(F.size("ns") < F.size("kids"), F.transform("ns", lambda n: n.withField("opaque", F.lit(True)))).otherwise(F.col("ns")))
    merged = merged.select(*ids, F.concat("pointer", F.lit("!both")).alias("pointer"), F.lit("plain").alias("kind"), F.aggregate(F.slice("ns", 2, 100_000), F.get("ns", F.lit(0)), _narrowed).alias("n"), strings().alias("kids"), F.lit(None).cast("string").alias("say"), F.lit("").alias("text"), F.lit(None).cast(_STRINGS).alias("types"))
    listed = settle(table.unionByName(merged).join(kid_types, [*ids, "pointer"], "left"))
    # Of alternatives whose types are pairwise disjoint, never more than one holds.
    apart = (F.size("kid_types") == F.size("kids")) & (F.size(F.flatten("kid_types")) == F.size(F.array_distinct(F.flatten("kid_types"))))
    return listed.withColumn("kind", F.when(apart & (F.col("kind") == "one"), "any").otherwise(F.col("kind")))


def union_forms(reg: DataFrame, ids: list[str]) -> DataFrame:
    """(ids..., pointer, form, branches): how nodes offer alternatives. types: a list of types; anyOf: branches of which
    some must hold, among them those of a oneOf with pairwise disjoint types; oneOf: exactly one must hold."""
    nodes = graph(reg, ids).filter(F.col("kind").isin("any", "one") | ((F.col("kind") == "plain") & (F.size("types") > 1) & F.col("n.enum").isNull() & ~F.contains("pointer", F.lit("!t"))))
    form = F.when(F.col("kind") == "plain", "types").when(F.col("kind") == "any", "anyOf").otherwise("oneOf")
    return nodes.select(*ids, F.regexp_replace("pointer", "![a-z]+$", "").alias("pointer"), form.alias("form"), F.when(F.col("kind") == "plain", F.array_sort("types")).otherwise(F.col("kids")).alias("branches"))


def _narrowed(a: Column, b: Column) -> Column:
    """A node that accepts whatever both do, and perhaps more: the tighter of each limit, else the first one's."""
    flag = lambda k, c: F.when(c, b[k]).otherwise(a[k])
    low, high = (b["lo"] > a["lo"]) | ((b["lo"] == a["lo"]) & b["lo_open"]) | a["lo"].isNull(), (b["hi"] < a["hi"]) | ((b["hi"] == a["hi"]) & b["hi_open"]) | a["hi"].isNull()
    ints = F.when(F.array_contains(a["types"], "number") & F.array_contains(b["types"], "integer"), F.array_union(a["types"], F.array(F.lit("integer")))).otherwise(a["types"])
    out = a.withField("types", F.when(a["types"].isNull(), b["types"]).when(b["types"].isNull(), a["types"]).otherwise(F.array_intersect(ints, F.when(F.array_contains(b["types"], "number"), F.array_union(b["types"], F.array(F.lit("integer")))).otherwise(b["types"]))))
    for k, c in (("lo", low), ("lo_open", low), ("hi", high), ("hi_open", high), ("closed", b["shut"]), ("shut", b["shut"]), ("at_rest", a["at_rest"].isNull() & ~a["shut"]), ("whole", b["whole"])):
        out = out.withField(k, flag(k, F.coalesce(c, F.lit(False))))
    for k in ("min_len", "min_items", "min_props"):
        out = out.withField(k, F.greatest(a[k], b[k]))
    for k in ("max_len", "max_items", "max_props"):
        out = out.withField(k, F.least(a[k], b[k]))
    for k in ("step", "pattern", "at_names", "names", "at_items", "at_contains", "contains", "max_contains"):
        out = out.withField(k, F.coalesce(a[k], b[k]))
    later = F.map_filter(b["at_props"], lambda k, _: ~F.map_contains_key(a["at_props"], k))
    out = out.withField("at_props", F.map_concat(a["at_props"], later)).withField("uniq", a["uniq"] | b["uniq"])
    nested = lambda x: (F.size(x["at_props"]) > 0) | (F.size(x["at_pats"]) > 0) | x["shut"] | x["at_rest"].isNotNull() | x["at_names"].isNotNull() | x["at_items"].isNotNull() | (F.size(x["at_prefix"]) > 0) | x["at_contains"].isNotNull() | (F.size(x["deps"]) > 0)
    vague = (a["pattern"] != b["pattern"]) | (a["step"] != b["step"]) | (F.size(a["types"]) == 0)
    out = out.withField("odd_pats", a["odd_pats"] | b["odd_pats"]).withField("opaque", a["opaque"] | b["opaque"] | (nested(a) & nested(b)) | F.coalesce(vague, F.lit(False)))
    for k in ("props", "never", "required"):
        out = out.withField(k, F.array_union(a[k], b[k]))
    return out.withField("text", F.concat(F.lit("both "), a["text"], b["text"]))


_EDGES = "array<struct<clause:string,choice:string,exact:int,flip:boolean,sp:string,tp:string>>"


def _steps(raw: Column, s: Column, t: Column) -> Column:
    """The clauses of the goal that node s lies within node t, as an array of edges to further goals."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)

    def edge(clause, choice, sp, tp, exact=0, flip: bool = False) -> Column:
        """exact: 2 if the clause holds just when this choice does, 1 if just when some of its choices does."""
        return F.struct(as_col(clause).alias("clause"), as_col(choice).alias("choice"), as_col(exact).cast("int").alias("exact"), F.lit(flip).alias("flip"), as_col(sp).alias("sp"), as_col(tp).alias("tp"))

    none = F.array().cast(_EDGES)
    some = lambda test, edges: F.when(F.coalesce(test, F.lit(False)), edges).otherwise(none)
    one = lambda test, e: some(test, F.array(e))
    kid = lambda x, i: F.get(x["kids"], F.lit(i))
    at, to = s["pointer"], t["pointer"]
    single = F.coalesce((s["kind"] == "plain") & (F.size(s["n"]["enum"]) == 1), F.lit(False))
    # Where s is split: all its shares must lie in t.
    parts = [
        some(s["kind"].isin("any", "one"), F.transform(s["kids"], lambda k: edge("x", "each", k, to, exact=F.when(s["kind"] == "any", 2).otherwise(0)))),
        some(s["kind"] == "all", F.transform(s["kids"], lambda k: edge("x", F.concat(F.lit("k"), k), k, to, exact=F.when(F.size(s["kids"]) == 1, 2).otherwise(0)))),
        one((s["kind"] == "all") & (F.size(s["kids"]) > 1), edge("x", "both", F.concat(at, F.lit("!both")), to, exact=2)),
        some(s["kind"] == "if", F.array(edge("x", "then", kid(s, 1), to), edge("x", "then", kid(s, 2), to))),
    ]
    shares = [
        some((s["kind"] == "plain") & s["n"]["enum"].isNull() & (F.size(s["n"]["types"]) > 1), F.transform(s["n"]["types"], lambda x: edge("x", "types", F.concat(at, F.lit("!t"), x), to, exact=2))),
        some((s["kind"] == "plain") & (F.size(s["n"]["enum"]) > 1), F.transform(s["n"]["enum"], lambda x: edge("x", "values", F.concat(at, F.lit("!e"), x), to, exact=2))),
    ]
    any_type = F.coalesce(s["types"], F.array(*map(F.lit, _TYPES)))
    s_types = F.when(F.array_contains(any_type, "number"), F.array_union(any_type, F.array(F.lit("integer")))).otherwise(any_type)
    apart = lambda i: ~F.exists(F.transform(t["kid_types"], lambda k, j: (i != j) & F.arrays_overlap(k, s_types)), lambda x: x)
    picks = F.transform(t["kids"], lambda k, i: F.struct(k.alias("k"), i.alias("i")))
    # One branch takes all of s, and s lies apart from each other branch that has types of it.
    rivals = lambda x: F.filter(picks, lambda y: (y["i"] != x["i"]) & F.arrays_overlap(F.get(t["kid_types"], y["i"]), s_types))
    into_one = F.flatten(F.transform(picks, lambda x: F.concat(F.array(edge("x", F.concat(F.lit("b"), x["k"]), at, x["k"], exact=F.when(F.coalesce(apart(x["i"]), F.lit(False)), 2).otherwise(0))), F.transform(rivals(x), lambda y: edge("x", F.concat(F.lit("b"), x["k"]), at, F.concat(y["k"], F.lit("!no")))))))
    into_any = F.transform(picks, lambda x: edge("x", F.concat(F.lit("b"), x["k"]), at, x["k"], exact=F.when(F.coalesce(apart(x["i"]), F.lit(False)), 2).when(single, 1).otherwise(0)))
    union = F.flatten(F.array(F.when(t["kind"] == "any", into_any).otherwise(into_one), *parts, *shares))
    same_if = (s["kind"] == "if") & (s["say"] == t["say"]) & ~F.contains(s["say"], F.lit('"$ref"'))
    conditional = F.flatten(F.array(
        some(same_if, F.array(edge("x", "same", kid(s, 1), kid(t, 1)), edge("x", "same", kid(s, 2), kid(t, 2)))),
        F.array(edge("x", "through", at, kid(t, 1)), edge("x", "through", at, kid(t, 2))), *parts[:3],
    ))
    negated = F.flatten(F.array(one(s["kind"] == "not", edge("x", "not", kid(t, 0), kid(s, 0), flip=True)), *parts))
    return (
        F.when(s["kind"].isNull() | t["kind"].isNull(), none)
        .when(t["kind"] == "all", F.transform(t["kids"], lambda k: edge(k, "it", at, k, exact=True)))
        .when(t["kind"].isin("any", "one"), union).when(t["kind"] == "not", negated).when(t["kind"] == "if", conditional)
        .when(s["kind"] == "plain", F.when(s["n"]["enum"].isNull() & (t["n"]["text"] != "true"), _inner(raw, s["n"], t["n"], at, edge, none)).otherwise(none)).otherwise(F.flatten(F.array(*parts)))
    )


def _inner(raw: Column, s: Column, t: Column, at: Column, edge, none: Column) -> Column:
    """Goals for the child schemas of two plain nodes."""
    some = lambda test, edges: F.when(F.coalesce(test, F.lit(False)), edges).otherwise(none)
    get = lambda m, k: F.try_element_at(m, k)
    s_names, t_names, s_pats, t_pats = (F.map_keys(m) for m in (s["at_props"], t["at_props"], s["at_pats"], t["at_pats"]))
    obj, arr = _has(s, "object"), _has(s, "array")
    true = F.lit("true")
    beyond = F.coalesce(s["at_rest"], true)  # what undeclared names of s may hold; none if it is shut
    common = F.transform(F.array_intersect(s_names, t_names), lambda k: edge(F.concat(F.lit("p"), k), "it", get(s["at_props"], k), get(t["at_props"], k), exact=True))
    by_pattern = F.flatten(F.transform(s_names, lambda k: F.transform(F.filter(t_pats, lambda p: _like(k, p)), lambda p: edge(F.concat(F.lit("q"), k, F.lit("/"), p), "it", get(s["at_props"], k), get(t["at_pats"], p), exact=True))))
    outside = F.filter(F.array_except(s_names, t_names), lambda k: ~F.exists(t_pats, lambda p: _like(k, p)))
    extra = some(t["at_rest"].isNotNull(), F.transform(outside, lambda k: edge(F.concat(F.lit("x"), k), "it", get(s["at_props"], k), t["at_rest"], exact=True)))
    lacking = F.filter(F.array_except(t_names, s_names), lambda k: F.coalesce(F.array_contains(s["name_list"], k), F.lit(True)))
    named = s["at_names"].isNull() | s["name_list"].isNotNull()
    patterned = lambda k: F.filter(s_pats, lambda p: _like(k, p))
    unsaid = some(raw, F.flatten(F.transform(lacking, lambda k: F.when(F.size(patterned(k)) > 0, F.transform(patterned(k), lambda p: edge(F.concat(F.lit("y"), k), p, get(s["at_pats"], p), get(t["at_props"], k)))).when(~s["shut"], F.array(edge(F.concat(F.lit("y"), k), "it", beyond, get(t["at_props"], k), exact=named))).otherwise(none))))
    patterns = F.flatten(F.transform(t_pats, lambda q: F.flatten(F.array(
        F.transform(F.filter(s_pats, lambda p: p == q), lambda p: edge(F.concat(F.lit("r"), q), "it", get(s["at_pats"], p), get(t["at_pats"], q), exact=True)),
        F.transform(F.filter(s_pats, lambda p: (p != q) & ~F.array_contains(s_pats, q)), lambda p: edge(F.concat(F.lit("r"), q, F.lit("/"), p), "it", get(s["at_pats"], p), get(t["at_pats"], q))),
        some(raw & ~s["shut"] & ~F.array_contains(s_pats, q), F.array(edge(F.concat(F.lit("s"), q), "it", beyond, get(t["at_pats"], q)))),
    ))))
    rest = some(raw & t["at_rest"].isNotNull() & ~s["shut"], F.array(edge("rest", "it", beyond, t["at_rest"], exact=s["at_names"].isNull())))
    strays = some(t["at_rest"].isNotNull() | t["shut"], F.transform(F.array_except(s_pats, t_pats), lambda p: edge(F.concat(F.lit("z"), p), "it", get(s["at_pats"], p), F.coalesce(t["at_rest"], F.lit("none")))))
    names = some(t["at_names"].isNotNull(), F.flatten(F.array(
        some(s["at_names"].isNotNull(), F.array(edge("names", "names", s["at_names"], t["at_names"], exact=raw & ~s["shut"] & (F.size(s_pats) == 0) & s["name_list"].isNotNull()))),
        some((F.size(s_pats) == 0) & (s["shut"] | ~raw), F.array(edge("names", "listed", F.when(F.size(s_names) > 0, F.concat(at, F.lit("!names"))).otherwise("true"), t["at_names"], exact=F.size(s_names) > 0))),
        some((F.size(s_pats) > 0) | (raw & ~s["shut"] & s["at_names"].isNull()), F.array(edge("names", "any", true, t["at_names"], exact=s["at_names"].isNull() & (F.size(s_pats) == 0)))),
    )))
    long = F.greatest(F.size(s["at_prefix"]), F.size(t["at_prefix"]))
    item = lambda n, i: F.coalesce(F.get(n["at_prefix"], i), n["at_items"])
    places = F.filter(F.sequence(F.lit(0), long), lambda i: item(t, i).isNotNull() & F.coalesce(i < s["max_items"], F.lit(True)))
    items = F.transform(places, lambda i: edge(F.concat(F.lit("i"), i.cast("string")), "it", F.coalesce(item(s, i), true), item(t, i), exact=True))
    enough = F.coalesce(s["min_contains"] >= t["min_contains"], F.lit(False)) & s["at_contains"].isNotNull() & t["max_contains"].isNull()
    all_are = F.coalesce(s["min_items"] >= t["min_contains"], F.lit(False)) & F.coalesce(s["max_items"] <= t["max_contains"], t["max_contains"].isNull())
    fixed = F.filter(F.sequence(F.lit(0), F.size(s["at_prefix"])), lambda i: (i < F.size(s["at_prefix"])) & F.coalesce(i < s["min_items"], F.lit(False)) & (t["min_contains"] <= 1) & t["max_contains"].isNull())
    needed = t["at_contains"].isNotNull() & ~F.coalesce(s["contains"] == t["contains"], F.lit(False)) & ((t["min_contains"] > 0) | t["max_contains"].isNotNull())
    within = F.coalesce(s["max_contains"] <= t["max_contains"], F.lit(False)) & F.coalesce(s["min_contains"] >= t["min_contains"], F.lit(False)) & s["at_contains"].isNotNull()
    contained = some(needed, F.flatten(F.array(
        some(enough, F.array(edge("c", "contains", s["at_contains"], t["at_contains"]))),
        some(within, F.array(edge("c", "both ways", s["at_contains"], t["at_contains"]), edge("c", "both ways", t["at_contains"], s["at_contains"], flip=True))),
        some(all_are & (F.size(s["at_prefix"]) == 0), F.array(edge("c", "items", F.coalesce(s["at_items"], true), t["at_contains"]))),
        F.transform(fixed, lambda i: edge("c", i.cast("string"), F.get(s["at_prefix"], i), t["at_contains"])),
        F.array(edge("c", "none", true, F.lit("none"))),
    )))
    return F.flatten(F.array(some(obj, F.flatten(F.array(common, by_pattern, extra, unsaid, patterns, rest, strays, names))), some(arr, F.flatten(F.array(items, contained)))))


def _disjoint(a: Column, b: Column) -> Column:
    """Whether two plain nodes certainly share no value."""
    n = lambda c: F.coalesce(c, F.lit(False))
    wide = lambda x: F.when(F.array_contains(x["types"], "number"), F.array_append(x["types"], F.lit("integer"))).otherwise(x["types"])
    only = lambda x, *ts: n((F.size(x["types"]) > 0) & (F.size(F.array_except(x["types"], F.array(*map(F.lit, ts)))) == 0))
    misses = lambda x, y: n(F.forall(x["enum"], lambda v: ~F.coalesce(_fits(v, y), F.lit(True))))
    numbers, texts = only(a, "integer", "number") | only(b, "integer", "number"), only(a, "string") | only(b, "string")
    far = n(a["lo"] > b["hi"]) | n(b["lo"] > a["hi"]) | n((a["lo"] == b["hi"]) & (a["lo_open"] | b["hi_open"])) | n((b["lo"] == a["hi"]) & (b["lo_open"] | a["hi_open"]))
    lengths = n(a["min_len"] > b["max_len"]) | n(b["min_len"] > a["max_len"])
    objects = only(a, "object") | only(b, "object")
    arrays = only(a, "array") | only(b, "array")
    counts = lambda lo, hi: n(a[lo] > b[hi]) | n(b[lo] > a[hi])
    needed = F.array_union(a["required"], b["required"])
    tagged = F.exists(F.array_intersect(F.array_intersect(F.map_keys(a["tags"]), F.map_keys(b["tags"])), needed), lambda k: ~F.arrays_overlap(F.try_element_at(a["tags"], k), F.try_element_at(b["tags"], k)))
    lacks = lambda x, y: (x["closed"] & (F.size(F.array_except(y["required"], x["props"])) > 0)) | F.arrays_overlap(x["never"], y["required"])
    return (a["text"] == "false") | (b["text"] == "false") | ~n(F.coalesce(F.arrays_overlap(wide(a), wide(b)), F.lit(True))) | misses(a, b) | misses(b, a) | (numbers & far) | (texts & lengths) | (objects & (lacks(a, b) | lacks(b, a) | n(tagged) | counts("min_props", "max_props"))) | (arrays & counts("min_items", "max_items"))


def _goal_values(goals: DataFrame, pair: list[str]) -> DataFrame:
    """(pair..., direction, sp, tp, value) of the pairs' first goals: 2 within, 0 not within, 1 not decided."""
    key = [*pair, "direction", "flip", "sp", "tp"]
    edges = goals.select(*key, F.explode("edges").alias("e"))
    edges = settle(edges.select(*key, "e.clause", "e.choice", "e.exact", *pair_as(pair, "c_"), F.col("direction").alias("c_direction"), (F.col("flip") != F.col("e.flip")).alias("c_flip"), F.col("e.sp").alias("c_sp"), F.col("e.tp").alias("c_tp")))
    values = settle(goals.select(*key, F.col("own").alias("value")))
    choices = settle(edges.groupBy(*key).agg(F.count_distinct("clause", "choice").alias("n"), F.count_distinct("clause").alias("m"), F.min("exact").alias("exact")).filter("n > m OR exact = 0").groupBy(*pair, "direction").count())
    single = values.join(choices, [*pair, "direction"], "left_anti").groupBy(*pair, "direction").agg(F.min("value").alias("value"))
    values, edges = values.join(choices, [*pair, "direction"], "left_semi"), edges.join(choices, [*pair, "direction"], "left_semi")
    own, total = values, None
    while True:
        child = values.select(*[F.col(k).alias(f"c_{k}") for k in key], F.col("value").alias("v"))
        met = edges.join(child, [f"c_{k}" for k in key])
        chosen = met.groupBy(*key, "clause", "choice").agg(F.min("v").alias("v"), F.min("exact").alias("exact"))
        none = F.max(F.when((F.col("exact") == 0) | (F.col("v") > 0), 1).otherwise(0)) == 0
        clauses = chosen.groupBy(*key, "clause").agg(F.when(F.max("v") == 2, 2).when(none | (F.max((F.col("exact") == 2) & (F.col("v") == 0))), 0).otherwise(1).alias("v"))
        lowered = own.join(clauses.groupBy(*key).agg(F.min("v").alias("v")), key, "left")
        values = settle(lowered.select(*key, F.least("value", F.coalesce("v", "value")).alias("value")))
        before, total = total, values.agg(F.coalesce(F.sum("value"), F.lit(0))).first()[0]
        if total == before:
            break
    roots = values.filter("sp = '#' AND tp = '#' AND NOT flip").select(*pair, "direction", "value")
    return single.unionByName(roots)


#: Beyond all numbers that are exact.
_FAR = "9" * 20


def _covered(s: Column, t: Column) -> Column:
    """Whether the numbers of plain node s lie in the ranges of the alternatives t together, by a sweep over the ranges in
    order of their beginnings: true, false where the alternatives for numbers are ranges and no more, else NULL."""
    n, whole = s["n"], s["n"]["whole"]
    kind = F.get(n["types"], F.lit(0))
    mine = F.transform(t["kid_ranges"], lambda r, i: F.struct(F.array_contains(F.get(t["kid_types"], i), kind).alias("for_it"), r.alias("r")))
    usable = F.filter(mine, lambda x: x["for_it"] & x["r"].isNotNull() & (whole | ~x["r"]["whole"]))
    ordered = F.array_sort(F.transform(usable, lambda x: x["r"]))
    # Covered up to `end`, `closed` if with it; a range takes over where it leaves no number between.
    start = F.struct(F.coalesce(n["lo"], F.lit("-" + _FAR).cast(EXACT)).alias("end"), (n["lo_open"] | n["lo"].isNull()).alias("closed"), F.lit(True).alias("fresh"))

    def sweep(a: Column, r: Column) -> Column:
        # Between whole numbers nothing is missing: the next to be covered is end, or end + 1 if that is covered.
        following = F.when(a["closed"] & ~a["fresh"], a["end"] + 1).otherwise(a["end"])
        meets = F.when(whole, (r["lo"] < following) | ((r["lo"] == following) & ~r["lo_open"])).otherwise((r["lo"] < a["end"]) | ((r["lo"] == a["end"]) & (a["closed"] | ~r["lo_open"])))
        # The last whole number of a range.
        last = F.when(whole & r["hi_open"] & (F.floor(r["hi"]) == r["hi"]), r["hi"] - 1).when(whole, F.floor(r["hi"])).otherwise(r["hi"]).cast(EXACT)
        closed = whole | ~r["hi_open"]
        further = F.when(a["fresh"], last >= a["end"]).otherwise((last > a["end"]) | ((last == a["end"]) & closed & ~a["closed"]))
        return F.when(meets & further, F.struct(last.alias("end"), closed.alias("closed"), F.lit(False).alias("fresh"))).otherwise(a)

    top = F.coalesce(n["hi"], F.lit(_FAR).cast(EXACT))
    swept = F.aggregate(ordered, start, sweep, lambda a: ~a["fresh"] & ((a["end"] > top) | ((a["end"] == top) & (a["closed"] | n["hi_open"]))))
    numeric = (s["kind"] == "plain") & n["enum"].isNull() & (F.size(n["types"]) == 1) & kind.isin("integer", "number") & ~n["odd"]
    simple = F.forall(mine, lambda x: ~x["for_it"] | x["r"].isNotNull()) & n["step"].isNull() & ~n["opaque"]
    return F.when(F.coalesce(numeric & (t["kind"] == "any"), F.lit(False)), F.when(swept, True).when(F.coalesce(simple & (F.size(usable) == F.size(F.filter(mine, lambda x: x["for_it"]))), F.lit(False)), False))


def pair_as(pair: list[str], prefix: str) -> list[Column]:
    return [F.col(k).alias(prefix + k) for k in pair]


def _plainly(s: Column, t: Column) -> Column:
    """Whether t is the same as s, or accepts everything."""
    n = lambda c: F.coalesce(c, F.lit(False))
    same = n((s["text"] == t["text"]) & (F.contains("sp", F.lit("!")) == F.contains("tp", F.lit("!"))) & ~F.contains(s["text"], F.lit('"$ref"')) & (s["kind"] == t["kind"]))
    return same | n((t["kind"] == "plain") & t["n"]["text"].isin("true", "{}"))


@cache
def _next_goals(_application: str) -> Column:
    """The edges of a goal from the columns direction, flip, s and t; large, so it is built once for an application."""
    s, t = F.col("s"), F.col("t")
    done = _plainly(s, t) | _covered(s, t).isNotNull()  # what is settled without further goals must not leave any behind
    return F.when(done, F.array().cast(_EDGES)).otherwise(_steps((F.col("direction") == "serializer") | F.col("flip"), s, t).cast(_EDGES))


@cache
def _judged(_application: str) -> Column:
    """Struct of own (2 within, 0 not within, 1 not decided, by the two nodes alone) and told (issues), from the columns
    direction, flip, s, t and edges."""
    s, t = F.col("s"), F.col("t")
    n = lambda c: F.coalesce(c, F.lit(False))
    raw = (F.col("direction") == "serializer") | F.col("flip")
    both = n((s["kind"] == "plain") & (t["kind"] == "plain"))
    refusal = n((s["kind"] == "plain") & (t["kind"] == "not"))
    own_types = F.when(F.array_contains(t["types"], "number"), F.array_union(t["types"], F.array(F.lit("integer")))).otherwise(t["types"])
    every = F.array(*map(F.lit, _TYPES))
    spared = F.when(s["n"]["enum"].isNotNull(), every).otherwise(F.array_except(every, F.when(F.array_contains(s["n"]["types"], "number"), F.array_append(s["n"]["types"], F.lit("integer"))).otherwise(s["n"]["types"])))
    held = F.when(s["kind"] == "plain", F.when(~s["n"]["opaque"], F.coalesce(s["types"], every))).when(s["kind"] == "not", spared)
    foreign = n((t["kind"] != "not") & ((s["kind"] == "not") | (t["kind"] != "plain")) & (F.size(F.array_except(held, own_types)) > 0))

    def judge(nothing: Column) -> Column:
        sure = _plainly(s, t) | nothing
        told = F.when(both & ~sure, _issues(raw, s["n"], t["n"])).otherwise(F.array().cast(_ISSUE))
        hit = F.exists(s["n"]["enum"], lambda v: n(_fits(v, s["n"], False) & _fits(v, t["n"])))
        cover = _covered(s, t)
        told = F.when(~sure & n(~cover), _one_issue("anyOf", "numbers between the alternatives are possible")).when(~sure & refusal & n(t["n"]["text"].isin("true", "{}") | hit), _one_issue("not", "a value is excluded")).when(~sure & foreign, _one_issue("type", "a type is accepted by no branch")).otherwise(told)
        fine = sure | (refusal & _disjoint(s["n"], t["n"])) | n(cover)
        return let(F.struct(fine.alias("fine"), told.alias("told")), summed)

    def summed(x: Column) -> Column:
        broken = F.exists(x["told"], lambda i: i["keyword"] != "unknown")
        own = F.when(x["fine"], 2).when(broken, 0).when((F.size(x["told"]) > 0) | (~both & (F.size("edges") == 0)), 1).otherwise(2)
        return F.struct(own.alias("own"), x["told"].alias("told"), x["fine"].alias("fine"))

    return let(n((s["kind"] == "plain") & _no_value(s["n"], s["n"]["required"])), judge)


def _one_issue(keyword: str, message: str) -> Column:
    return F.array(F.struct(F.lit(50).alias("rank"), F.lit(keyword).alias("keyword"), F.lit(message).alias("message"))).cast(_ISSUE)


def goal_issues(pairs: DataFrame, pair: list[str]) -> DataFrame:
    """The rows of node_issues for pairs (pair..., role, old, new) whose contracts refer and combine."""
    docs = pairs.select(*pair, F.explode(F.array(F.struct(F.lit("old").alias("side"), F.col("old").alias("schema_json")), F.struct(F.lit("new").alias("side"), F.col("new").alias("schema_json")))).alias("d")).select(*pair, "d.*")
    nodes = graph(docs, [*pair, "side"])
    cols = ["pointer", "kind", "n", "kids", "say", "text", "types", "kid_types", "kid_ranges"]
    side = lambda name: nodes.select(*pair, F.col("side").alias(f"{name}_side"), F.col("pointer").alias(f"{name}p"), F.struct(*cols).alias(name))
    fresh = pairs.select(*pair, directions(F.col("role")).alias("direction"), F.lit(False).alias("flip"), F.lit("#").alias("sp"), F.lit("#").alias("tp"))
    key, done = [*pair, "direction", "flip", "sp", "tp"], []
    application = pairs.sparkSession.sparkContext.applicationId

    def met(goals: DataFrame) -> DataFrame:
        forth = (F.col("direction") == "serializer") != F.col("flip")
        sided = goals.withColumns({"s_side": F.when(forth, "new").otherwise("old"), "t_side": F.when(forth, "old").otherwise("new")})
        return sided.join(side("s"), [*pair, "s_side", "sp"], "left").join(side("t"), [*pair, "t_side", "tp"], "left")

    while True:
        found = settle(met(fresh).select(*key, _next_goals(application).alias("edges")))
        done.append(found)
        ahead = found.select(*pair, "direction", "flip", F.explode("edges").alias("e")).select(*pair, "direction", (F.col("flip") != F.col("e.flip")).alias("flip"), "e.sp", "e.tp").distinct()
        known = reduce(DataFrame.unionByName, [d.select(*key) for d in done])
        fresh = settle(ahead.join(known, key, "left_anti"))
        if fresh.isEmpty():
            break
    goals = met(reduce(DataFrame.unionByName, done)).select(*key, "edges", _judged(application).alias("j"))
    goals = settle(goals.select(*key, "j.own", "j.told", F.when(F.col("j.fine"), F.array().cast(_EDGES)).otherwise(F.col("edges")).alias("edges")))
    value = _goal_values(goals, pair)
    told = goals.select(*pair, "direction", F.col("tp").alias("pointer"), F.explode("told").alias("i")).filter("i.keyword <> 'unknown'")
    order = F.struct(F.size(F.split("pointer", "/")).alias("depth"), F.col("i.rank").alias("rank"), "pointer", F.col("i.keyword").alias("keyword"), F.col("i.message").alias("message"))
    first = told.groupBy(*pair, "direction").agg(F.min(order).alias("i"))
    rows = value.filter("value < 2").join(first, [*pair, "direction"], "left")
    sure = F.col("value") == 0
    return rows.select(*pair, "direction", F.regexp_replace(F.when(sure, F.coalesce("i.pointer", F.lit("#"))).otherwise("#"), "![^/]*", "").alias("pointer"), F.when(sure, F.coalesce("i.keyword", F.lit("not"))).otherwise("unknown").alias("keyword"), F.when(sure, F.coalesce("i.message", F.lit("a value is excluded"))).otherwise("not proven").alias("message"), F.when(sure, F.coalesce("i.rank", F.lit(50))).otherwise(99).alias("rank"))


def check_compat(pairs: DataFrame, pair: list[str]) -> DataFrame:
    """pairs: (pair..., role, old, new) with schema texts. One verdict per pair and direction. Equal texts with the same
    role are judged once, however many pairs have them."""
    texts = F.struct("role", "old", "new")
    keyed = settle(spread(pairs.select(*pair, "role", "old", "new"), *pair).withColumn("_same", F.sha2(F.to_json(texts), 256)))
    judged = _check_different(keyed.groupBy("_same").agg(F.first(texts).alias("t")).select("_same", "t.*"), ["_same"])
    return keyed.select(*pair, "_same").join(judged, "_same").drop("_same")


def _check_different(pairs: DataFrame, pair: list[str]) -> DataFrame:
    pairs = settle(spread(pairs, *pair).withColumn("_good", F.try_parse_json("old").isNotNull() & F.try_parse_json("new").isNotNull()))
    open_ones = pairs.filter(F.col("_good") & (F.col("old") != F.col("new")))
    rich = F.col("old").rlike(_RICH) | F.col("new").rlike(_RICH)
    simple, deep = open_ones.filter(~rich), open_ones.filter(rich)
    sides = simple.select(*pair, F.explode(F.array(F.struct(F.lit("old").alias("side"), F.col("old").alias("schema_json")), F.struct(F.lit("new").alias("side"), F.col("new").alias("schema_json")))).alias("s")).select(*pair, "s.*")
    issues = node_issues(node_table(schema_nodes(sides, [*pair, "side"]), [*pair, "side"]), simple, pair)
    if not deep.isEmpty():
        issues = issues.unionByName(goal_issues(deep, pair))
    unread = pairs.filter("NOT _good").select(*pair, directions(F.col("role")).alias("direction"), F.lit("#").alias("pointer"), F.lit("unknown").alias("keyword"), F.lit("not JSON").alias("message"), F.lit(99).alias("rank"))
    return verdicts(pairs, issues.unionByName(unread), pair)


def pair_verdict(verdict_rows: DataFrame, pair: list[str]) -> DataFrame:
    """Both directions together: incompatible before unknown before compatible."""
    worst = F.max(F.when(F.col("verdict") == "incompatible", 2).when(F.col("verdict") == "unknown", 1).otherwise(0))
    return verdict_rows.groupBy(*pair).agg(worst.alias("_w")).select(*pair, F.element_at(F.array(F.lit("compatible"), F.lit("unknown"), F.lit("incompatible")), F.col("_w") + 1).alias("verdict"))


def invalid_contracts(reg: DataFrame, ids: list[str]) -> DataFrame:
    """(ids...) of contracts (ids..., schema_json) that no one may have: no JSON, a keyword that isn't allowed, another
    dialect, a reference that leads nowhere."""
    nodes = settle(schema_nodes(reg, ids).select(*ids, "pointer", "node"))
    cons = constraints(nodes, ids)
    found = [keyword_findings(nodes, ids, HARD), dialect_findings(cons), unresolved_refs(cons, nodes, ids), reg.filter(F.try_parse_json("schema_json").isNull())]
    return reduce(DataFrame.unionByName, [f.select(*ids) for f in found]).distinct()


def grade(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, mode, status) for two golden tables (id, mode, schema_json, stable_id). The old mode is the role; the
    first of missing new, missing old, invalid, identical, incompatible, mode changed, ok that applies."""
    side = lambda df, p: df.select("id", *(F.col(c).alias(f"{p}_{c}") for c in ("mode", "schema_json", "stable_id")))
    met = side(old, "old").join(side(new, "new"), "id", "full_outer")
    pairs = met.filter("old_schema_json IS NOT NULL AND new_schema_json IS NOT NULL").select("id", F.col("old_mode").alias("role"), F.col("old_schema_json").alias("old"), F.col("new_schema_json").alias("new"))
    verdict = pair_verdict(check_compat(pairs, ["id"]), ["id"])
    sided = old.select("id", F.lit(0).alias("side"), "schema_json").unionByName(new.select("id", F.lit(1).alias("side"), "schema_json"))
    invalid = invalid_contracts(sided, ["id", "side"]).select("id").distinct().withColumn("invalid", F.lit(True))
    rows = met.join(verdict, "id", "left").join(invalid, "id", "left")
    status = (
        F.when(F.col("new_schema_json").isNull(), "missing_new").when(F.col("old_schema_json").isNull(), "missing_old").when(F.col("invalid"), "invalid")
        .when((canonical_hash(F.col("old_schema_json")) == canonical_hash(F.col("new_schema_json"))) & (F.col("old_mode") == F.col("new_mode")), "identical")
        .when(F.col("verdict") != "compatible", "incompatible").when(F.col("old_mode") != F.col("new_mode"), "mode_changed").otherwise("ok")
    )
    return rows.select(F.coalesce("new_stable_id", "old_stable_id").alias("id"), F.coalesce("old_mode", "new_mode").alias("mode"), status.alias("status"))


def gate(grades: DataFrame) -> DataFrame:
    """One row: failed is true if any entry is incompatible or invalid."""
    return grades.agg(F.coalesce(F.max(F.col("status").isin("incompatible", "invalid")), F.lit(False)).alias("failed"), F.count("*").alias("entries"))
