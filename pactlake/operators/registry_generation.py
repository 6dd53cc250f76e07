"""Values for contracts that are rows, and counterexamples for any two of them.

No contract is compiled: the rules of contract_rules() are the input. Every rule holds an array of candidate texts, one for
each attempt. In rounds, rules take their children's candidates by a join and build their own: scalars from bounds,
lengths and enumerations (the bounds themselves and every listed value among them), objects and arrays from their
children's, combined rules from their branches'; texts for a pattern are made once, before the rounds. A round reaches
one level higher; references and recursion need nothing else. What a candidate misses is left to the judgement by
registry_validation. All choice is by hashes of (seed, contract, rule, attempt), so lost tasks give the same rows again.
"""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlake.functions.pattern_text import pattern_texts, quoted
from pactlake.functions.settled import settle

from .compat import check_compat, directions
from .registry_scan import SAFE_PATTERN, let
from .registry_validation import NO, YES, contract_key, contract_rules, judge_parts

_STRINGS = "array<string>"
_EDGES = "array<struct<role:string,name:string,child:string>>"
#: Values for what no rule speaks about; the text that stands for one of them until all parts of a value are merged.
_FREE = ("0", '"x"', "true", "null", "[]", "{}", "1.5", "-7")
_ANY = '"\\u0000'


def _edges(n: Column, leads: Column) -> Column:
    """The rules that a rule builds its values from: p a property, f a name without a rule, i a place in an array, e all
    other items, c contained items, a and n parts of which all count, o branches of which one counts, d, t and l condition, then and else,
    v what is negated."""
    none = F.array().cast(_EDGES)
    edge = lambda role, name, child: F.struct(F.lit(role).alias("role"), name.alias("name"), child.alias("child"))
    one = lambda role, child: F.when(child.isNotNull(), F.array(edge(role, F.lit(""), child))).otherwise(none)
    listed = lambda role, rules: F.coalesce(F.transform(rules, lambda r, i: edge(role, i.cast("string"), r)), none)
    props = F.transform(F.map_entries(n["at_props"]), lambda e: edge("p", e["key"], e["value"]))
    bare = F.filter(F.array_union(n["required"], F.flatten(F.map_values(n["deps"]))), lambda k: ~F.map_contains_key(n["at_props"], k))
    matched = lambda k: F.get(F.filter(F.map_keys(n["at_pats"]), lambda p: F.when(p.rlike(SAFE_PATTERN), F.regexp_like(k, p)).otherwise(False)), F.lit(0))
    named = F.transform(bare, lambda k: edge("p", k, F.coalesce(F.try_element_at(n["at_pats"], matched(k)), n["at_rest"])))
    return F.filter(F.flatten(F.array(
        props, named, listed("i", n["at_prefix"]), one("x", n["at_rest"]), one("e", n["at_items"]), one("c", n["at_contains"]), listed("a", leads["all_of"]), one("a", leads["ref"]), listed("n", F.transform(leads["depends"], lambda d: d["rule"])), listed("o", F.coalesce(leads["any_of"], leads["one_of"])), one("v", leads["not_of"]), one("d", leads["if_of"]), one("t", leads["then_of"]), one("l", leads["else_of"]),
    )), lambda e: e["child"].isNotNull())


def _free(h: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, _FREE)), (F.pmod(h, F.lit(len(_FREE))) + 1).cast("int"))


def _plain(number: Column) -> Column:
    """A decimal as text without zeros at its end."""
    return F.regexp_replace(F.regexp_replace(number.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def _number(n: Column, h: Column, whole: Column) -> Column:
    """A bound, or a number between the bounds; a thousand wide where one is missing."""
    lo = F.coalesce(n["lo"], n["hi"] - 1000, F.lit(-1000).cast("decimal(38,18)"))
    hi = F.coalesce(n["hi"], lo + 2000)
    step = F.coalesce(n["step"], F.when(whole, F.lit(1).cast("decimal(38,18)")))
    first, last = F.ceil(lo / step).cast("decimal(38,0)"), F.floor(hi / step).cast("decimal(38,0)")
    pick = F.pmod(h, F.lit(4))
    many = F.least(last - first + 1, F.lit(10**12).cast("decimal(38,0)")).cast("long")
    stepped = F.when(pick == 0, first).when(pick == 1, last).otherwise(first + F.pmod(F.shiftright(h, 2), F.greatest(many, F.lit(1).cast("long"))).cast("decimal(38,0)"))
    share = F.pmod(F.shiftright(h, 2), F.lit(1023)) + 1
    between = lo.cast("double") + (hi - lo).cast("double") * share / 1024
    free = F.when((pick == 0) & ~n["lo_open"], lo).when((pick == 1) & ~n["hi_open"], hi).when(pick == 2, F.least(F.greatest(F.floor(between).cast("decimal(38,18)"), lo), hi)).otherwise(between.cast("decimal(38,6)").cast("decimal(38,18)"))
    return _plain(F.when(step.isNotNull(), (stepped * step).cast("decimal(38,18)")).otherwise(free))


def _missed(n: Column) -> Column:
    """Numbers just outside a rule's own bounds, which a rule that negates it takes."""
    least = F.when(n["lo_open"], n["lo"]).otherwise((n["lo"] - 1).cast("decimal(38,18)"))
    most = F.when(n["hi_open"], n["hi"]).otherwise((n["hi"] + 1).cast("decimal(38,18)"))
    return F.array_compact(F.array(_plain(least), _plain(most)))


def _text(n: Column, h: Column) -> Column:
    lo = F.coalesce(n["min_len"], F.lit(0)).cast("int")
    hi = F.least(F.coalesce(n["max_len"], lo + 10), lo + 300).cast("int")
    pick = F.pmod(h, F.lit(4))
    size = F.when(pick == 0, lo).when(pick == 1, hi).otherwise(lo + F.pmod(F.shiftright(h, 2), F.greatest(hi - lo + 1, F.lit(1)).cast("long")).cast("int"))
    letters = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(size / 32).cast("int")), lambda i: F.md5(F.concat(F.hex(h), F.lit("/"), i.cast("string")))), "")
    return F.concat(F.lit('"'), F.substr(letters, F.lit(1), size), F.lit('"'))


def _object(n: Column, kids: Column, a: Column, hashed, strays: bool) -> Column:
    """Required and some other properties; names that come with them; others to reach the least number."""
    got = lambda k: F.get(F.try_element_at(kids, F.concat(F.lit("p"), k)), a)
    few = F.coalesce(n["min_props"] > F.size(n["required"]), F.lit(False))
    chosen = F.filter(F.map_keys(n["at_props"]), lambda k: ~F.array_contains(n["required"], k) & ~F.array_contains(n["never"], k) & got(k).isNotNull() & (few | (F.pmod(hashed(k), F.lit(2)) == 0)))
    room = F.coalesce(n["max_props"], F.lit(10_000)).cast("int")
    spare = F.coalesce(n["name_list"], F.transform(F.sequence(F.lit(1), F.greatest(n["min_props"].cast("int"), F.lit(1))), lambda i: F.concat(F.lit("x"), i.cast("string"))))
    lacking = lambda x: F.greatest(F.coalesce(n["min_props"], F.lit(0)).cast("int") - F.size(x), F.lit(0))
    # Where undeclared names are welcome, every fourth attempt has one.
    more = lambda x: F.lit(strays) & ~n["shut"] & (F.pmod(hashed(F.lit("+")), F.lit(4)) == 0) & (F.size(x) < room)
    steps = [
        lambda x: F.array_union(x, F.flatten(F.map_values(F.map_filter(n["deps"], lambda k, _: F.array_contains(x, k))))),
        lambda x: F.array_union(x, F.flatten(F.map_values(F.map_filter(n["deps"], lambda k, _: F.array_contains(x, k))))),
        lambda x: F.concat(x, F.slice(F.array_except(spare, x), F.lit(1), lacking(x))),
        lambda x: F.array_union(x, F.when(more(x), F.array(F.coalesce(F.get(n["name_list"], F.lit(0)), F.lit("x1")))).otherwise(F.array().cast(_STRINGS))),
    ]
    names = F.concat(n["required"], F.slice(chosen, F.lit(1), F.greatest(room - F.size(n["required"]), F.lit(0))))
    for step in steps:
        names = let(names, step)
    stray = F.coalesce(F.get(F.try_element_at(kids, F.lit("x")), a), F.when(n["at_rest"].isNull(), F.concat(F.lit(_ANY), F.pmod(hashed(F.lit("-")), F.lit(len(_FREE))).cast("string"), F.lit('"'))))
    field = lambda k: F.concat(quoted(k), F.lit(":"), F.coalesce(got(k), F.when(~F.map_contains_key(n["at_props"], k), stray)))
    # A required property without a value yet leaves the object without one.
    return let(F.transform(names, field), lambda fs: F.when(~F.exists(fs, lambda f: f.isNull()), F.concat(F.lit("{"), F.array_join(fs, ","), F.lit("}"))))


def _array(n: Column, kids: Column, a: Column, attempts: int, hashed) -> Column:
    kid = lambda role, at: F.get(F.try_element_at(kids, role), F.pmod(at, F.lit(attempts)))
    lo = F.coalesce(n["min_items"], F.lit(0)).cast("int")
    hi = F.least(F.coalesce(n["max_items"], lo + 3), lo + 20).cast("int")
    size = lo + F.pmod(hashed(F.lit("#")), F.greatest(hi - lo + 1, F.lit(1)).cast("long")).cast("int")
    contained = F.when(n["at_contains"].isNotNull(), F.coalesce(n["min_contains"], F.lit(1)).cast("int")).otherwise(0)
    prefix = F.size(n["at_prefix"])

    def place(i: Column) -> Column:
        other = F.when(i < prefix + contained, kid(F.lit("c"), a + i)).when(n["at_items"].isNotNull(), kid(F.lit("e"), a + i)).otherwise(_free(hashed(i)))
        return F.when(i < prefix, kid(F.concat(F.lit("i"), i.cast("string")), a)).otherwise(other)

    items = F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), place)).otherwise(F.array().cast(_STRINGS))
    items = let(items, lambda x: F.when(n["uniq"], F.array_distinct(x)).otherwise(x))
    return let(items, lambda x: F.when(~F.exists(x, lambda f: f.isNull()), F.concat(F.lit("["), F.array_join(x, ","), F.lit("]"))))


def _merged(texts: Column) -> Column:
    """One object of all that are objects, the first one's properties before the next one's, but a value that stands for
    any other after those that don't; else the first text."""
    fields = lambda t: F.try_variant_get(F.try_parse_json(t), "$", "map<string,variant>")
    vague = lambda v: F.startswith(F.to_json(v), F.lit(_ANY))
    lost = lambda x, y, k: F.map_contains_key(x, k) & ~(vague(F.try_element_at(x, k)) & ~vague(F.try_element_at(y, k)))
    joined = lambda x, y: let(F.map_filter(y, lambda k, _: ~lost(x, y, k)), lambda z: F.to_json(F.map_concat(F.map_filter(x, lambda k, _: ~F.map_contains_key(z, k)), z)))
    both = lambda a, b: let(F.struct(fields(a).alias("x"), fields(b).alias("y")), lambda m: F.when(m["x"].isNull() | m["y"].isNull(), a).otherwise(joined(m["x"], m["y"])))
    return F.aggregate(F.slice(texts, 2, 10_000), F.get(texts, F.lit(0)), both)


@cache
def _candidates(_application: str, seed: int, attempts: int, strays: bool) -> Column:
    """The array of a rule's candidates from the columns contract, rule, n, leads, first, texts, kids and beside."""
    n, leads, kids = F.col("n"), F.col("leads"), F.col("kids")
    named = lambda r, rules: F.transform(F.coalesce(rules, F.array().cast(_STRINGS)), lambda _, i: F.concat(F.lit(r), i.cast("string")))
    says = lambda *ks: reduce(lambda x, y: x | y, (n[k].isNotNull() for k in ks))
    object_says = (F.size(n["at_props"]) > 0) | (F.size(n["required"]) > 0) | n["shut"] | says("at_rest", "max_props")
    array_says = (F.size(n["at_prefix"]) > 0) | n["uniq"] | says("at_items", "at_contains", "min_items", "max_items")
    guess = F.array_compact(F.array(F.when(object_says, "object"), F.when(array_says, "array"), F.when(says("min_len", "max_len", "pattern"), "string"), F.when(says("lo", "hi", "step"), "number")))
    kinds = F.coalesce(F.when(F.size(n["types"]) > 0, n["types"]), F.when(F.size(guess) > 0, guess), F.array(F.lit("free")))
    combined = leads["any_of"].isNotNull() | leads["one_of"].isNotNull() | leads["then_of"].isNotNull() | leads["else_of"].isNotNull()

    def one(a: Column) -> Column:
        at = a + F.col("first")
        hashed = lambda *more: F.xxhash64(F.lit(seed), "contract", "rule", at, *more)
        turn = F.pmod(F.xxhash64(F.lit(seed), "contract", "rule"), F.lit(1_000_003)) + at  # takes every choice in turn

        def own(kind: Column) -> Column:
            return (
                F.when(n["text"] == "false", F.lit(None).cast("string")).when(F.size(n["enum"]) > 0, F.get(n["enum"], F.pmod(turn, F.size(n["enum"])).cast("int"))).when(kind == "null", "null").when(kind == "boolean", F.when(F.pmod(turn, F.lit(2)) == 0, "true").otherwise("false"))
                .when(kind.isin("integer", "number"), _number(n, hashed(), kind == "integer")).when(kind == "string", F.coalesce(quoted(F.get(F.col("texts"), a)), _text(n, hashed()))).when(kind == "array", _array(n, kids, a, attempts, hashed)).when(kind == "object", _object(n, kids, a, hashed, strays)).otherwise(_free(turn))
            )

        branch = lambda key: F.get(F.try_element_at(kids, key), a)
        chosen = F.when(leads["if_of"].isNotNull(), F.array(let(F.array_compact(F.array(branch(F.lit("t")), branch(F.lit("d")))), _merged), branch(F.lit("l")))).otherwise(F.array().cast(_STRINGS))
        options = F.array_compact(F.concat(F.transform(named("o", F.coalesce(leads["any_of"], leads["one_of"])), branch), chosen))
        picked = let(options, lambda x: F.when(combined & (F.size(x) > 0), F.get(x, F.pmod(turn, F.size(x)).cast("int"))))
        others = F.transform(F.concat(named("a", leads["all_of"]), F.array(F.lit("a")), named("n", F.transform(leads["depends"], lambda d: d["rule"]))), branch)
        # What lies just below a negated range may well be outside of it; where bounds are negated, so do numbers at them.
        below = _plain(branch(F.lit("v")).try_cast("decimal(38,18)") - 1)
        edge = F.get(F.col("beside"), F.pmod(F.floor(turn / 2), F.greatest(F.size("beside"), F.lit(1))).cast("int"))
        beside = F.when(leads["not_of"].isNotNull(), F.array(F.when(F.pmod(turn, F.lit(2)) == 0, below).otherwise(F.coalesce(edge, below)))).otherwise(F.array().cast(_STRINGS))
        mixed = combined | leads["not_of"].isNotNull() | leads["ref"].isNotNull() | (F.size(leads["all_of"]) > 0) | (F.size(leads["depends"]) > 0)
        # Parts that are objects become one; of others the first counts, so they take turns to come first.
        turned = lambda x: let(F.pmod(F.xxhash64("rule", at), F.greatest(F.size(x), F.lit(1))).cast("int"), lambda k: let(F.concat(F.slice(x, k + 1, F.size(x)), F.slice(x, F.lit(1), k)), _merged))
        mine = let(F.get(kinds, F.pmod(turn, F.size(kinds)).cast("int")), own)
        return let(mine, lambda m: F.when(mixed, let(F.array_compact(F.concat(F.array(picked), others, beside, F.array(m))), turned)).otherwise(m))

    return F.transform(F.sequence(F.lit(0), F.lit(attempts - 1)), one)


def candidate_values(rules: DataFrame, contracts: DataFrame, attempts: int = 16, first: int = 0, seed: int = 42, most_rounds: int = 8, strays: bool = True) -> DataFrame:
    """(contract, attempt, value): candidates for the contracts (column contract) among the rules, `attempts` for each.
    Rounds end when no rule gets other candidates, or after most_rounds, where recursive contracts are cut. Without
    strays no candidate has a property that its contract doesn't declare."""
    application = rules.sparkSession.sparkContext.applicationId
    nodes = rules.join(contracts.select("contract").distinct(), "contract", "left_semi").withColumn("first", F.lit(first))
    texts = pattern_texts(F.col("n.pattern"), F.col("n.min_len").cast("double"), F.col("n.max_len").cast("double"), F.xxhash64(F.lit(seed), "contract", "rule", F.lit(first)), F.lit(attempts))
    nodes = settle(nodes.drop("leaves").withColumn("texts", texts))
    links = settle(nodes.select("contract", F.col("rule").alias("parent"), F.explode(_edges(F.col("n"), F.col("leads"))).alias("e")).select("contract", "parent", "e.*"))
    empty = F.map_from_arrays(F.array().cast(_STRINGS), F.array().cast("array<array<string>>"))
    none = F.array().cast(_STRINGS)
    values, before = None, None
    for _ in range(most_rounds):
        if values is None:
            met = nodes.withColumns({"kids": empty, "outside": none, "beside": none})
        else:
            # Of two edges with one name the first counts; which one is the same on every run.
            met = links.join(values.select("contract", F.col("rule").alias("child"), "found", "missed"), ["contract", "child"]).groupBy("contract", "parent", "role", F.concat("role", "name").alias("key")).agg(F.min("found").alias("found"), F.min("missed").alias("missed"))
            numbers = lambda *roles: F.array_sort(F.flatten(F.collect_list(F.when(F.col("role").isin(*roles), F.col("missed")))))
            met = met.groupBy("contract", "parent").agg(F.map_from_entries(F.collect_list(F.struct("key", "found"))).alias("_kids"), numbers("a", "n", "o").alias("_outside"), numbers("v").alias("_beside"))
            met = nodes.join(met.withColumnRenamed("parent", "rule"), ["contract", "rule"], "left").withColumns({"kids": F.coalesce("_kids", empty), "outside": F.coalesce("_outside", none), "beside": F.coalesce("_beside", none)})
        outside = F.slice(F.array_union(_missed(F.col("n")), F.col("outside")), 1, 64)
        values = settle(met.select("contract", "rule", _candidates(application, seed, attempts, strays).alias("found"), outside.alias("missed")))
        now = values.agg(F.coalesce(F.sum(F.xxhash64("contract", "rule", "found", "missed").cast("decimal(38,0)")), F.lit(0))).first()[0]
        if now == before:
            break
        before = now
    roots = values.filter("rule = '#'").select("contract", F.posexplode("found").alias("attempt", "value"))
    if not strays:
        roots = roots.filter(~F.contains("value", F.lit(_ANY)))
    for i, text in enumerate(_FREE):
        roots = roots.withColumn("value", F.replace("value", F.lit(f'{_ANY}{i}"'), F.lit(text)))
    return roots.filter("value IS NOT NULL").withColumn("attempt", F.col("attempt") + first)


def _different(made: DataFrame) -> DataFrame:
    """Each candidate of a contract once, as its first attempt."""
    return made.groupBy("contract", "value").agg(F.min("attempt").alias("attempt"))


def generate_registered(contracts: DataFrame, key: list[str], attempts: tuple[int, ...] = (8, 32, 128, 512), seed: int = 42) -> DataFrame:
    """(key..., value, tried, status) for contracts (key..., schema_json): the first candidate that the contract accepts
    (found), or NULL: exhausted. Later rounds of attempts are made only for contracts that have no value yet. Equal
    contracts are flattened and searched once."""
    named = settle(contracts.select(*key, contract_key(F.col("schema_json")).alias("contract"), "schema_json"))
    rules = contract_rules(named.select("schema_json"))
    found, first, missing = [], 0, named.select("contract").distinct()
    for many in attempts:
        tried = settle(_different(candidate_values(rules, missing, many, first, seed)).withColumn("row", F.monotonically_increasing_id()))
        good = tried.join(judge_parts(tried.select("row", "contract", F.try_parse_json("value").alias("value")), rules), "row").filter(F.col("v") == YES)
        found.append(settle(good.groupBy("contract").agg(F.min(F.struct("attempt", "value")).alias("w"))))
        first += many
        missing = settle(missing.join(found[-1], "contract", "left_anti"))
        if missing.isEmpty():
            break
    hits = reduce(DataFrame.unionByName, found)
    status = F.when(F.col("w").isNotNull(), "found").otherwise("exhausted")
    return named.join(hits, "contract", "left").select(*key, F.col("w.value").alias("value"), F.coalesce(F.col("w.attempt") + 1, F.lit(first)).alias("tried"), status.alias("status"))


def counterexamples(pairs: DataFrame, pair: list[str], attempts: tuple[int, ...] = (16, 64, 256), seed: int = 42, strays: bool = True, proofs: bool = True) -> DataFrame:
    """(pair..., direction, witness, attempt) for pairs (pair..., role, old, new) of contracts: a value that the writing
    side accepts and the reading side rejects. Directions without one among all attempts have no row. Equal pairs of
    texts are searched once, and only those without a witness yet again. With proofs, pairs whose reading side is proven
    to take every value of the writing side, undeclared properties included, have none and are not searched."""
    sided = pairs.select(*pair, directions(F.col("role")).alias("direction"), "old", "new")
    forth = F.col("direction") == "serializer"
    sided = settle(sided.select(*pair, "direction", F.when(forth, F.col("new")).otherwise(F.col("old")).alias("src"), F.when(forth, F.col("old")).otherwise(F.col("new")).alias("dst")).withColumns({"_src": contract_key(F.col("src")), "_dst": contract_key(F.col("dst"))}))
    rules = contract_rules(sided.select(F.explode(F.array("src", "dst")).alias("schema_json")))
    left = sided.filter("_src <> _dst").select("_src", "_dst").distinct()
    if proofs:
        # As a new version that writes for an old one, whatever the direction: that way nothing is left out of account.
        texts = sided.filter("_src <> _dst").groupBy("_src", "_dst").agg(F.first("dst").alias("old"), F.first("src").alias("new")).withColumn("role", F.lit("serializer"))
        left = settle(left.join(check_compat(texts, ["_src", "_dst"]).filter("verdict = 'compatible'"), ["_src", "_dst"], "left_anti"))
    found, first = [], 0
    for many in attempts:
        made = candidate_values(rules, left.select(F.col("_src").alias("contract")), many, first, seed, strays=strays)
        made = settle(_different(made).withColumn("row", F.monotonically_increasing_id()))
        good = made.join(judge_parts(made.select("row", "contract", F.try_parse_json("value").alias("value")), rules), "row").filter(F.col("v") == YES).drop("row", "v")
        tried = settle(good.withColumnRenamed("contract", "_src").join(left, "_src").withColumn("row", F.monotonically_increasing_id()))
        bad = tried.join(judge_parts(tried.select("row", F.col("_dst").alias("contract"), F.try_parse_json("value").alias("value")), rules), "row").filter(F.col("v") == NO)
        found.append(settle(bad.groupBy("_src", "_dst").agg(F.min(F.struct("attempt", "value")).alias("w"))))
        first += many
        left = settle(left.join(found[-1], ["_src", "_dst"], "left_anti"))
        if left.isEmpty():
            break
    hits = reduce(DataFrame.unionByName, found)
    return sided.join(hits, ["_src", "_dst"]).select(*pair, "direction", F.col("w.value").alias("witness"), F.col("w.attempt").alias("attempt"))


def first_counterexamples(pairs: DataFrame, pair: list[str], **more) -> DataFrame:
    """(pair..., direction, witness, attempt), one row for a pair: of both directions the serializer's comes first."""
    order = F.when(F.col("direction") == "serializer", 0).otherwise(1)
    return counterexamples(pairs, pair, **more).groupBy(*pair).agg(F.min_by(F.struct("direction", "witness", "attempt"), order).alias("w")).select(*pair, "w.*")


def refute_unknown(verdicts: DataFrame, pairs: DataFrame, pair: list[str], attempts: tuple[int, ...] = (16, 64)) -> DataFrame:
    """The rows of check_compat for pairs (pair..., role, old, new), those that are unknown searched for a witness: with
    one they are incompatible, keyword witness, the value in the message. Only values without undeclared properties
    count, which both directions look at."""
    undecided = verdicts.filter("verdict = 'unknown'").select(*pair, F.col("direction").alias("role"))
    found = counterexamples(undecided.join(pairs.drop("role"), pair), pair, attempts, strays=False, proofs=False).select(*pair, "direction", "witness")
    met = verdicts.join(found, [*pair, "direction"], "left")
    hit = F.col("witness").isNotNull()
    told = {"verdict": "incompatible", "pointer": "#", "keyword": "witness"}
    return met.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in told.items()} | {"message": F.coalesce("witness", "message")}).drop("witness")


def grade_examples(grades: DataFrame, old: DataFrame, new: DataFrame, **more) -> DataFrame:
    """(id, mode, status, example) for grades and the golden tables (id, mode, schema_json) they come from: a value that
    shows why an entry is incompatible by its old mode; NULL for other entries, and where no attempt finds one."""
    wrong = grades.filter("status = 'incompatible'").select("id")
    pairs = old.select("id", F.col("mode").alias("role"), F.col("schema_json").alias("old")).join(new.select("id", F.col("schema_json").alias("new")), "id").join(wrong, "id", "left_semi")
    return grades.join(first_counterexamples(pairs, ["id"], **more).select("id", F.col("witness").alias("example")), "id", "left")
