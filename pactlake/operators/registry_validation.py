"""Records judged by contracts that are rows: no contract is compiled, each record may have its own.

Every contract text is flattened once into rules (contract, pointer, what the node says, the nodes it leads to). Records
become goals "this part of the record satisfies that node": a goal meets its rule by (contract, pointer), is judged on
what the node itself says, and leads to further goals for properties, items, branches and references, each with the part
of the record that it is about. Levels of goals are expanded until none is left, then values are folded back from the
deepest level: a clause of a goal holds if the number of its goals that hold lies in the clause's range (at least one for
anyOf, exactly one for oneOf, none for not, all for the rest). Values are true, false, or not decided, and a clause is
decided wherever the undecided goals can't change it. Goals about strings, numbers, booleans and nulls whose node leads
nowhere are judged with the goal that leads to them; they are no rows.

Not decided are unevaluated keywords, patterns beyond a plain kind, references that lead nowhere or only to themselves,
and numbers of more digits than are exact. Work is a row for each part of a record and rule that meet; a common contract
makes rows of one key, which Spark's skewed joins split.
"""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactlake.functions.settled import settle, spread
from pactlake.functions.values import Variant, once

from .registry_scan import SAFE_PATTERN, let, ref_target, schema_nodes, with_normal_form

NO, OPEN, YES = 0, 1, 2
_STRINGS = "array<string>"
_CHILDREN = "array<struct<clause:string,least:int,most:int,flip:boolean,rule:string,value:variant,here:boolean>>"
#: What judging asks of a rule, and what it asks of one that is met by a string, number, boolean or null only.
_SCALAR = ("types", "enum", "lo", "lo_open", "hi", "hi_open", "step", "odd", "min_len", "max_len", "pattern")
_ASKED = (*_SCALAR, "min_items", "max_items", "uniq", "required", "min_props", "max_props", "deps", "shut", "odd_pats", "at_props", "at_pats", "at_rest", "at_names", "at_items", "at_prefix", "at_contains", "min_contains", "max_contains")
#: A node that leads to more different nodes than this takes none of them along; they are met a level below.
NEAR = 64
_UNJUDGED = ("unevaluatedProperties", "unevaluatedItems", "$dynamicRef")


def contract_key(schema_json: Column) -> Column:
    return F.sha2(schema_json, 256)


def contract_rules(contracts: DataFrame) -> DataFrame:
    """(contract, rule, n, leads) of different contract texts in column schema_json: n as in normalised(), leads: the
    pointers of combined nodes, and whether there are none (alone). contract is that of the rows, which are different
    then, or contract_key()."""
    docs = contracts
    if "contract" not in contracts.columns:
        docs = contracts.select("schema_json").distinct().select(contract_key(F.col("schema_json")).alias("contract"), "schema_json")
    nodes = schema_nodes(spread(docs, "contract"), ["contract"])
    v, at = F.col("node"), F.col("pointer")
    keys = F.coalesce(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), F.array().cast(_STRINGS))
    has = lambda k: F.array_contains(keys, k)
    under = lambda k: F.concat(at, F.lit(f"/{k}"))
    branches = lambda k: F.coalesce(F.transform(F.try_variant_get(v, f"$['{k}']", "array<variant>"), lambda _, i: F.concat(under(k), F.lit("/"), i.cast("string"))), F.array().cast(_STRINGS))
    combining = ("allOf", "anyOf", "oneOf", "not", "if", "$ref", "dependentSchemas")
    depends = F.coalesce(F.map_keys(F.try_variant_get(v, "$['dependentSchemas']", "map<string,variant>")), F.array().cast(_STRINGS))
    token = lambda k: F.replace(F.replace(k, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    leads = F.struct(
        branches("allOf").alias("all_of"), F.when(has("anyOf"), branches("anyOf")).alias("any_of"), F.when(has("oneOf"), branches("oneOf")).alias("one_of"),
        F.when(has("not"), under("not")).alias("not_of"), F.when(has("if") & (has("then") | has("else")), under("if")).alias("if_of"), F.when(has("then"), under("then")).alias("then_of"), F.when(has("else"), under("else")).alias("else_of"),
        F.when(has("$ref"), ref_target(F.try_variant_get(v, "$['$ref']", "string"))).alias("ref"),
        F.transform(depends, lambda k: F.struct(k.alias("key"), F.concat(under("dependentSchemas"), F.lit("/"), token(k)).alias("rule"))).alias("depends"),
        F.arrays_overlap(keys, F.array(*map(F.lit, _UNJUDGED))).alias("vague"), (~F.arrays_overlap(keys, F.array(*map(F.lit, combining)))).alias("alone"),
    )
    return settle(with_normal_form(nodes.withColumn("leads", leads), "n").select("contract", at.alias("rule"), "n", "leads"))


def _kind(v: Variant) -> Column:
    whole = F.coalesce(v.exact() % 1 == 0, v.number() % 1 == 0)

    def of(start: Column) -> Column:
        """By the first two letters of the type's name."""
        return (
            F.when(start == "ST", "string").when(start == "BI", "integer").when(start == "OB", "object").when(start == "AR", "array").when(start == "VO", "null").when(start == "BO", "boolean")
            .when(start.isin("DE", "DO", "FL") & whole, "integer").otherwise("number")
        )

    return let(F.left(F.schema_of_variant(v.col), F.lit(2)), of)


def _matches(text: Column, pattern: Column) -> Column:
    return F.regexp_like(text, F.replace(pattern, F.lit("$"), F.lit(r"\z")))


def _own(v: Variant, n: Column, kind: Column, keys: Column | None = None) -> Column:
    """What the node itself says about a value: NO, OPEN or YES; keys: those of an object, None if the value is no array
    and no object. A bound that isn't there is looked at before the value."""
    holds = lambda c: F.coalesce(c, F.lit(True))
    within = lambda bound, test: F.when(n[bound].isNull(), True).otherwise(test(n[bound]))
    near, exact = v.number(), v.exact()
    beyond = lambda test: lambda bound: F.coalesce(test(exact, bound), test(near, bound.cast("double")), F.lit(True))
    number = F.when(n["odd"], F.lit(None).cast("boolean")).otherwise(
        F.when(n["lo_open"], within("lo", beyond(lambda x, b: x > b))).otherwise(within("lo", beyond(lambda x, b: x >= b)))
        & F.when(n["hi_open"], within("hi", beyond(lambda x, b: x < b))).otherwise(within("hi", beyond(lambda x, b: x <= b)))
        & F.when(n["step"].isNull(), True).otherwise(exact % n["step"] == 0)
    )
    pattern = lambda t: F.when(n["pattern"].isNull(), True).when(n["pattern"].rlike(SAFE_PATTERN), _matches(t, n["pattern"]))
    text = let(v.text(), lambda t: within("min_len", lambda b: holds(F.length(t) >= b)) & within("max_len", lambda b: holds(F.length(t) <= b)) & pattern(t))
    typed = holds(F.array_contains(n["types"], kind) | ((kind == "integer") & F.array_contains(n["types"], "number")))
    listed = holds(F.array_contains(n["enum"], v.canonical()))
    said = lambda rest: F.when(n["text"].isin("true", "{}"), YES).when((n["text"] == "false") | ~typed | ~listed, NO).otherwise(F.coalesce(rest.cast("int") * YES, F.lit(OPEN)))
    rest = F.when(kind.isin("integer", "number"), number).when(kind == "string", text)
    if keys is None:
        return said(rest.otherwise(True))
    items = v.items()
    alike = ~n["uniq"] | (F.size(F.array_distinct(F.transform(items, lambda e: Variant(e).canonical()))) == F.size(items))
    array = within("min_items", lambda b: holds(F.size(items) >= b)) & within("max_items", lambda b: holds(F.size(items) <= b)) & alike
    known = lambda k: F.map_contains_key(n["at_props"], k) | F.exists(F.map_keys(n["at_pats"]), lambda p: F.when(p.rlike(SAFE_PATTERN), _matches(k, p)).otherwise(False))

    def object_(keys: Column) -> Column:
        bound = F.forall(F.map_entries(n["deps"]), lambda d: ~F.array_contains(keys, d["key"]) | (F.size(F.array_except(d["value"], keys)) == 0))
        shut = ~n["shut"] | F.forall(keys, known)
        own = (F.size(F.array_except(n["required"], keys)) == 0) & within("min_props", lambda b: holds(F.size(keys) >= b)) & within("max_props", lambda b: holds(F.size(keys) <= b)) & bound & shut
        return F.when(n["odd_pats"] & (F.size(keys) > 0), F.when(own, F.lit(None).cast("boolean")).when(n["shut"], F.lit(None).cast("boolean")).otherwise(own)).otherwise(own)

    return said(rest.when(kind == "array", array).when(kind == "object", object_(keys)).otherwise(True))


def _children(v: Variant, n: Column, leads: Column, kind: Column, keys: Column) -> Column:
    """The goals that a goal leads to; keys: those of an object."""
    none = F.array().cast(_CHILDREN)
    whole = lambda x: x if isinstance(x, Column) else F.lit(x)

    def goal(clause, rule, value, least=None, most=None, flip=False, here=False) -> Column:
        """least NULL: all goals of the clause must hold."""
        return F.struct(whole(clause).alias("clause"), whole(least).cast("int").alias("least"), whole(most).cast("int").alias("most"), F.lit(flip).alias("flip"), whole(rule).alias("rule"), value.alias("value"), F.lit(here).alias("here"))

    some = lambda test, goals: F.when(F.coalesce(test, F.lit(False)), goals).otherwise(none)
    mine = lambda clause, rule, **more: goal(clause, rule, v.col, here=True, **more)
    each = lambda clause, rules, **more: F.coalesce(F.transform(rules, lambda r: mine(clause, r, **more)), none)
    entries = F.map_entries(F.try_variant_get(v.col, "$", "map<string,variant>"))

    def of_entry(e: Column) -> Column:
        declared = F.try_element_at(n["at_props"], e["key"])
        pats = F.filter(F.map_keys(n["at_pats"]), lambda p: F.when(p.rlike(SAFE_PATTERN), _matches(e["key"], p)).otherwise(False))
        stray = n["at_rest"].isNotNull() & ~n["odd_pats"] & declared.isNull() & (F.size(pats) == 0)
        matched = F.flatten(F.array(F.array(declared, F.when(stray, n["at_rest"])), F.transform(pats, lambda p: F.try_element_at(n["at_pats"], p))))
        rules = F.array_compact(F.when((F.size(n["at_pats"]) == 0) & ~n["odd_pats"], F.array(F.coalesce(declared, n["at_rest"]))).otherwise(matched))
        goals = F.transform(rules, lambda r: goal("all", r, e["value"]))
        return F.when(n["at_names"].isNull(), goals).otherwise(F.flatten(F.array(goals, F.array(goal("all", n["at_names"], e["key"].cast("variant"))))))

    places = F.transform(v.items(), lambda e, i: F.struct(e.alias("e"), F.coalesce(F.get(n["at_prefix"], i), n["at_items"]).alias("rule")))
    items = F.transform(F.filter(places, lambda x: x["rule"].isNotNull()), lambda x: goal("all", x["rule"], x["e"]))
    contained = F.transform(v.items(), lambda e: goal("contains", n["at_contains"], e, least=n["min_contains"], most=n["max_contains"]))
    depends = F.filter(leads["depends"], lambda d: F.coalesce(F.array_contains(keys, d["key"]), F.lit(False)))
    parts = F.when(kind == "object", F.flatten(F.transform(entries, of_entry))).when(kind == "array", F.flatten(F.array(items, some(n["at_contains"].isNotNull(), contained)))).otherwise(none)
    combined = F.flatten(F.array(
        F.transform(depends, lambda d: mine("all", d["rule"])), each("all", leads["all_of"]), each("any", leads["any_of"], least=1), each("one", leads["one_of"], least=1, most=1),
        some(leads["not_of"].isNotNull(), F.array(mine("all", leads["not_of"], flip=True))), some(leads["ref"].isNotNull(), F.array(mine("all", leads["ref"]))),
        some(leads["if_of"].isNotNull() & leads["then_of"].isNotNull(), F.array(mine("then", leads["if_of"], least=1, flip=True), mine("then", leads["then_of"], least=1))),
        some(leads["if_of"].isNotNull() & leads["else_of"].isNotNull(), F.array(mine("else", leads["if_of"], least=1), mine("else", leads["else_of"], least=1))),
    ))
    return F.when(leads["alone"], parts).otherwise(F.flatten(F.array(parts, combined)))


@cache
def _columns(_application: str) -> dict[str, Column]:
    """What is made of the columns value, n, leads, passed and rule of a goal, and then of each goal c that it leads to,
    with its rule m; large, so they are built once. As columns they are compiled, in lambdas they would be interpreted."""
    v, n, leads, kind, keys = Variant(F.col("value")), F.col("n"), F.col("leads"), F.col("kind"), F.col("keys")
    lost = n.isNull() | F.array_contains("passed", F.col("rule"))
    c, m, kind_c = F.col("c"), F.col("m"), F.col("kind_c")
    return {
        "keys": v.keys(), "kind": F.when(keys.isNotNull(), "object").otherwise(_kind(v)),
        "own": F.when(lost | leads["vague"], OPEN).otherwise(_own(v, n, kind, keys)),
        "children": F.when(lost | (F.col("own") == NO), F.array().cast(_CHILDREN)).otherwise(_children(v, n, leads, kind, keys)),
        "m": F.try_element_at("near", c["rule"]), "kind_c": F.when(m.isNotNull(), F.when(c["here"], kind).otherwise(_kind(Variant(c["value"])))),
        "v": F.when(m.isNotNull() & ~kind_c.isin("array", "object"), _own(Variant(c["value"]), m, kind_c)),
    }


def _decided(least: Column, most: Column, sure: Column, maybe: Column) -> Column:
    """The value of a clause from the numbers of its goals that hold and that are not decided."""
    up = sure + maybe
    return F.when((sure >= least) & F.coalesce(up <= most, F.lit(True)), YES).when((up < least) | F.coalesce(sure > most, F.lit(False)), NO).otherwise(OPEN)


def _clause(goals: DataFrame, parent: list[str]) -> DataFrame:
    """(parent..., v): the least value of the parent's clauses, from the values v of their goals."""
    v = F.when(F.col("flip"), YES - F.col("v")).otherwise(F.col("v"))
    counted = goals.withColumn("v", v).groupBy(*parent, "clause").agg(F.max("least").alias("least"), F.max("most").alias("most"), F.count_if(F.col("v") == YES).alias("sure"), F.count_if(F.col("v") == OPEN).alias("maybe"), F.count("*").alias("n"))
    return counted.withColumn("v", _decided(F.coalesce("least", F.col("n")), F.col("most"), F.col("sure"), F.col("maybe"))).groupBy(*parent).agg(F.min("v").alias("v"))


def judged_rules(rules: DataFrame) -> DataFrame:
    """rules with what judging asks of n, and near: the rules that a rule leads to and that lead nowhere, by pointer, as
    values that are no arrays or objects need them; NULL where there are none or more than NEAR."""
    word = F.when(F.col("n.text").isin("true", "false", "{}"), F.col("n.text")).otherwise("").alias("text")
    short = rules.select("contract", "rule", F.struct(word, *(F.col(f"n.{c}").alias(c) for c in _ASKED)).alias("n"), "leads", F.struct(word, *(F.col(f"n.{c}").alias(c) for c in _SCALAR)).alias("m"))
    one = lambda *cols: F.array(*(F.col(c) for c in cols))
    many = lambda c: F.coalesce(F.col(c), F.array().cast(_STRINGS))
    below = F.flatten(F.array(
        F.map_values("n.at_props"), F.map_values("n.at_pats"), many("n.at_prefix"), many("leads.all_of"), many("leads.any_of"), many("leads.one_of"), F.transform("leads.depends", lambda d: d["rule"]),
        one("n.at_rest", "n.at_names", "n.at_items", "n.at_contains", "leads.not_of", "leads.if_of", "leads.then_of", "leads.else_of", "leads.ref"),
    ))
    to = short.select("contract", F.col("rule").alias("from"), F.array_distinct(F.array_compact(below)).alias("to")).filter(F.size("to") <= NEAR)
    plain = short.filter(F.col("leads.alone") & ~F.col("leads.vague")).select("contract", "rule", "m")
    near = to.select("contract", "from", F.explode("to").alias("rule")).join(plain, ["contract", "rule"]).groupBy("contract", F.col("from").alias("rule")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "m"))).alias("near"))
    return settle(short.drop("m").join(near, ["contract", "rule"], "left"))


def judge_parts(goals: DataFrame, rules: DataFrame) -> DataFrame:
    """(row, v): NO, OPEN or YES for goals (row, contract, value VARIANT), rows different."""
    make, rules = _columns(goals.sparkSession.sparkContext.applicationId), judged_rules(rules)
    of_clause = {"parent": "string", "clause": "string", "least": "int", "most": "int", "flip": "boolean"}
    level = goals.select("row", "contract", F.lit("").alias("goal"), F.lit("#").alias("rule"), "value", F.array().cast(_STRINGS).alias("passed"), *(F.lit(None).cast(t).alias(c) for c, t in of_clause.items()))
    kept: list[tuple[DataFrame, DataFrame]] = []
    while True:
        # What a level needs of its rules travels with it once; only values and goals to come are stored. The first row
        # of a goal is its own, c is NULL there; the others are what it leads to, v is NULL for those to come.
        judged = level.join(rules, ["contract", "rule"], "left")
        for name in ("keys", "kind", "own", "children"):
            judged = judged.withColumn(name, make[name])
        rows = judged.select(*level.columns, "near", "kind", "own", F.posexplode(F.concat(F.array(F.lit(None)), "children")).alias("i", "c"))
        for name in ("m", "kind_c", "v"):
            rows = rows.withColumn(name, make[name])
        passed = F.when(F.col("c.here"), F.array_append("passed", F.col("rule"))).otherwise(F.array().cast(_STRINGS))
        mine = lambda x, y: F.when(F.col("c").isNull(), x).otherwise(y)
        rows = rows.select(
            "row", "contract", mine(F.col("goal"), F.concat_ws(".", "goal", "i")).alias("goal"), mine(F.col("parent"), F.col("goal")).alias("parent"), *(mine(F.col(k), F.col(f"c.{k}")).alias(k) for k in ("clause", "least", "most", "flip")),
            F.col("c.rule").alias("rule"), F.when(F.col("v").isNull(), F.col("c.value")).alias("value"), F.when(F.col("v").isNull(), passed).alias("passed"), mine(F.col("own"), F.col("v")).alias("v"),
        )
        rows = settle(rows)
        # A goal of the clause "all" that holds changes nothing.
        beside = rows.filter("rule IS NOT NULL AND v IS NOT NULL").filter((F.col("clause") != "all") | F.when(F.col("flip"), F.col("v") != NO).otherwise(F.col("v") != YES))
        kept.append((rows.filter("rule IS NULL"), beside))
        level = rows.filter("rule IS NOT NULL AND v IS NULL").select(*level.columns)
        if level.isEmpty():
            break
    below = None
    for depth in reversed(range(len(kept))):
        now, beside = kept[depth]
        part = ["row", "parent", "clause", "least", "most", "flip", "v"]
        by = ["row", "goal"] if depth else ["row"]
        ended = beside.select(*part) if below is None else beside.select(*part).unionByName(below)
        folded = _clause(ended, ["row", "parent"]).select("row", F.col("parent").alias("goal"), F.col("v").alias("folded"))
        now = now.join(folded.select(*by, "folded"), by, "left").withColumn("v", F.least("v", F.coalesce("folded", F.lit(YES))))
        below = now.select(*part)
    return now.select("row", "v")


def judge_records(records: DataFrame, contracts: DataFrame, key: list[str], text_col: str, to: str = "valid", found: str | None = None) -> DataFrame:
    """records with `to`: whether the JSON text satisfies the contract of its key; NULL where that is not decided or the
    registry contracts (key..., schema_json) has no such key; found: a column that is true where it has. A text that is no
    JSON is not valid. Equal texts under equal contracts are judged once."""
    named = settle(contracts.select(*key, "schema_json", contract_key(F.col("schema_json")).alias("_key")))
    # Records meet contracts by a number that is short to send and to sort by.
    different = settle(named.filter("schema_json IS NOT NULL").select("_key", "schema_json").distinct().withColumn("contract", F.monotonically_increasing_id()))
    rules = contract_rules(different.select("contract", "schema_json"))
    of = named.join(different.select("_key", F.col("contract").alias("_contract")), "_key", "left").select(*key, "_contract", *([F.lit(True).alias(found)] if found else []))
    rows = settle(records.join(of, key, "left"))
    tried = settle(rows.filter(F.col("_contract").isNotNull() & F.col(text_col).isNotNull()).select(F.col("_contract").alias("_c"), F.col(text_col).alias("_t")).distinct().withColumn("row", F.monotonically_increasing_id()))
    parsed = once(tried.select("row", F.col("_c").alias("contract"), "_t"), "value", F.try_parse_json("_t")).drop("_t").filter("value IS NOT NULL")
    values = tried.join(judge_parts(parsed, rules), "row").select("_c", "_t", F.col("v").alias("_v"))
    verdict = F.when(F.col("_contract").isNull(), F.lit(None).cast("boolean")).when(F.col("_v").isNull() | (F.col("_v") == NO), False).when(F.col("_v") == YES, True)
    met = rows.join(values, (F.col("_contract") == F.col("_c")) & (F.col(text_col) == F.col("_t")), "left")
    return met.withColumn(to, verdict).drop("_contract", "_c", "_t", "_v")


def stamp_registered(records: DataFrame, history: DataFrame, data_col: str, id_col: str = "stable_id", to: str = "envelope") -> DataFrame:
    """The records that the latest contract of their id accepts, wrapped as JSON {version, data}."""
    latest = settle(history.groupBy(id_col).agg(F.max_by(F.struct("version", "schema_json"), "version").alias("t")).select(id_col, "t.version", "t.schema_json"))
    good = judge_records(records, latest, [id_col], data_col, "_valid").filter("_valid").drop("_valid")
    stamped = good.join(latest.select(id_col, F.col("version").alias("_version")), id_col)
    return stamped.withColumn(to, F.to_json(F.struct(F.col("_version").alias("version"), F.try_parse_json(data_col).alias("data")))).drop("_version")


def read_registered(records: DataFrame, history: DataFrame, envelope_col: str, id_col: str = "stable_id") -> DataFrame:
    """records with version, data (JSON text) and valid: each judged by the contract of its id and version. An unknown
    version, a missing part or another key beside the two is not valid; NULL is not decided."""
    opened = records.withColumn("_e", F.try_parse_json(envelope_col))
    keys = F.map_keys(F.try_variant_get("_e", "$", "map<string,variant>"))
    shut = let(keys, lambda k: (F.size(k) == 2) & F.array_contains(k, "data") & F.array_contains(k, "version"))
    version = F.when(Variant(F.try_variant_get("_e", "$.version", "variant")).is_type("integer"), F.try_variant_get("_e", "$.version", "int"))
    opened = opened.withColumns({"version": version, "data": F.to_json(F.try_variant_get("_e", "$.data", "variant")), "_shut": F.coalesce(shut, F.lit(False))}).drop("_e")
    known = judge_records(opened, history, [id_col, "version"], "data", "_fits", "_known")
    valid = F.when(~F.col("_shut") | F.col("_known").isNull(), False).otherwise(F.col("_fits"))
    return known.withColumn("valid", valid).drop("_shut", "_known", "_fits")


def data_compat_registered(records: DataFrame, pairs: DataFrame, id_col: str, text_col: str, pair: list[str]) -> DataFrame:
    """(pair..., direction, seen, witnesses): over real records of each id, how many the writing side of a pair (pair...,
    role, old, new) accepts, and how many of these the reading side rejects. In the deserializer direction records with
    keys that the old side doesn't declare at its root are no emitted values and don't count. A witness proves the pair
    incompatible; none proves nothing."""
    from .compat import directions

    sided = pairs.select(*pair, directions(F.col("role")).alias("direction"), "old", "new")
    forth = F.col("direction") == "serializer"
    sided = sided.select(*pair, "direction", F.when(forth, F.col("new")).otherwise(F.col("old")).alias("src"), F.when(forth, F.col("old")).otherwise(F.col("new")).alias("dst"))
    sided = settle(sided.withColumns({"_src": contract_key(F.col("src")), "_dst": contract_key(F.col("dst"))}))
    rules = contract_rules(sided.select(F.explode(F.array("src", "dst")).alias("schema_json")))
    # A record is judged once by each contract of its id, however many pairs and sides have it; k is short for the contract.
    of = sided.select(id_col, F.explode(F.array("_src", "_dst")).alias("contract")).distinct()
    of = settle(of.withColumn("k", F.row_number().over(Window.partitionBy(id_col).orderBy("contract"))))
    rows = settle(records.select(id_col, F.col(text_col).alias("_t")).withColumn("_record", F.monotonically_increasing_id()))
    tried = settle(rows.join(of, id_col).select(id_col, "_record", "contract", "k", F.try_parse_json("_t").alias("value")).withColumn("row", F.monotonically_increasing_id()))
    verdicts = judge_parts(tried.select("row", "contract", "value").filter("value IS NOT NULL"), rules)
    declared = rules.filter("rule = '#'").select("contract", F.map_keys("n.at_props").alias("_declared"))
    strays = F.size(F.array_except(F.coalesce(F.map_keys(F.try_variant_get("value", "$", "map<string,variant>")), F.array().cast(_STRINGS)), "_declared")) > 0
    known = tried.join(declared, "contract", "left").select(id_col, "_record", "row", "k", F.coalesce(strays, F.lit(False)).alias("strays")).join(verdicts, "row", "left")
    # Records of an id that all its contracts judge alike are counted together.
    each = known.groupBy(id_col, "_record").agg(F.array_sort(F.collect_list(F.struct("k", "v", "strays"))).alias("_by"))
    alike = each.groupBy(id_col, "_by").agg(F.count("*").alias("_n"))
    side = lambda name: of.select(id_col, F.col("contract").alias(f"_{name}"), F.col("k").alias(f"_k_{name}"))
    met = sided.drop("src", "dst").join(side("src"), [id_col, "_src"]).join(side("dst"), [id_col, "_dst"]).join(alike, id_col)
    by = lambda name: F.get("_by", F.col(f"_k_{name}") - 1)
    emitted = (F.col("direction") == "serializer") | ~by("src")["strays"]
    seen = F.coalesce((by("src")["v"] == YES) & emitted, F.lit(False))
    total = lambda c: F.sum(F.when(c, F.col("_n")).otherwise(0))
    return met.groupBy(*pair, "direction").agg(total(seen).alias("seen"), total(seen & F.coalesce(by("dst")["v"] == NO, F.lit(False))).alias("witnesses"))
