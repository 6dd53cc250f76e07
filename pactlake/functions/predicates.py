"""Contracts (JSON Schema 2020-12) compiled to Column predicates.

Every keyword becomes one predicate that is vacuously true for values of another JSON type. The checks of a
conjunction are kept apart, each with its keyword and JSON pointer, so that a failing row can say why.
Local references are inlined. A recursive one is unrolled: max_depth is how often the same reference may be entered
again below itself. A predicate is NULL only for values that reach beyond that bound, and only where what lies there
would decide; NULL runs through and, or and not by three-valued logic.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import Guard, Typed, all_of, any_of, col_of, column, implies, negate

Check = tuple[str, str, Guard]
_UNDECIDED = "boolean"


def pointer_token(key: str) -> str:
    return str(key).replace("~", "~0").replace("/", "~1")


def resolve(root, ref: str):
    """The subschema at a local reference."""
    if not ref.startswith("#"):
        raise ValueError(f"reference is not local: {ref}")
    at = root
    for token in unquote(ref[1:]).split("/")[1:]:
        token = token.replace("~1", "/").replace("~0", "~")
        at = at[int(token)] if isinstance(at, list) else at[token]
    return at


def pattern_supported(pattern: str) -> bool:
    """Whether the pattern means the same to Java's engine; others must not be silently false."""
    try:
        re.compile(pattern)
    except re.error:
        return False
    return not re.search(r"\\c[A-Za-z]|\(\?<[=!]|\\k<|\\u\{", pattern)


def java_pattern(pattern: str) -> str:
    """The pattern with $ as the very end of the text; Java's also stands before a last line break."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        in_class = c == "[" or (in_class and c != "]")
        out.append(r"\z" if c == "$" and not in_class else c)
        i += 1
    return "".join(out)


def _matches(text: Column, pattern: str) -> Guard:
    if not pattern_supported(pattern):
        raise ValueError(f"unsupported pattern: {pattern}")
    return col_of(text.rlike(java_pattern(pattern)))


@dataclass(frozen=True)
class _Scope:
    """Where a contract is compiled: the document, the references entered so far, and whether one was cut."""

    root: object
    max_depth: int
    entered: tuple[str, ...] = ()
    cuts: list = field(default_factory=list)

    def enter(self, ref: str) -> _Scope | None:
        if self.entered.count(ref) > self.max_depth:
            self.cuts.append(ref)
            return None
        return replace(self, entered=(*self.entered, ref))


def compile_contract(schema, value: Typed, root=None, max_depth: int = 4) -> Column:
    """One predicate; NULL where the value reaches deeper into a recursive contract than max_depth."""
    return _whole(schema, value, _Scope(schema if root is None else root, max_depth))


def contract_checks(schema, value: Typed, pointer: str = "#", root=None, max_depth: int = 4) -> list[Check]:
    return _checks(schema, value, pointer, _Scope(schema if root is None else root, max_depth))


def _whole(schema, value: Typed, scope: _Scope) -> Column:
    return column(all_of(*(c for _, _, c in _checks(schema, value, "#", scope))))


def _checks(schema, value: Typed, pointer: str, scope: _Scope) -> list[Check]:
    if schema is True or schema == {}:
        return []
    if schema is False:
        return [("false", pointer, False)]
    sub = lambda s, v=value: _whole(s, v, scope)
    out: list[Check] = []
    put = lambda keyword, check: out.append((keyword, f"{pointer}/{keyword}", check))
    v, s = value, schema
    string, number, obj, arr = (v.is_type(t) for t in ("string", "number", "object", "array"))

    if "type" in s:
        names = [s["type"]] if isinstance(s["type"], str) else s["type"]
        put("type", any_of(*(v.is_type(t) for t in names)))
    if "enum" in s:
        put("enum", any_of(*(v.equals(x) for x in s["enum"])))
    if "const" in s:
        put("const", v.equals(s["const"]))
    for k, test in (("minLength", lambda n: F.length(v.text()) >= n), ("maxLength", lambda n: F.length(v.text()) <= n)):
        if k in s:
            put(k, implies(string, col_of(test(s[k])) if string is not False else True))
    if "pattern" in s:
        put("pattern", implies(string, _matches(v.text(), s["pattern"])) if string is not False else True)
    bounds = {"minimum": lambda x, n: x >= n, "maximum": lambda x, n: x <= n, "exclusiveMinimum": lambda x, n: x > n, "exclusiveMaximum": lambda x, n: x < n}
    for k, test in bounds.items():
        if k in s:
            put(k, implies(number, v.compared(test, s[k])) if number is not False else True)
    if "multipleOf" in s and number is not False:
        put("multipleOf", implies(number, v.multiple(s["multipleOf"])))
    if obj is not False:
        _object_checks(s, v, obj, sub, put, out, pointer, scope)
    if arr is not False:
        _array_checks(s, v, arr, sub, put, scope)
    if "allOf" in s:
        for i, x in enumerate(s["allOf"]):
            out += _checks(x, v, f"{pointer}/allOf/{i}", scope)
    if "anyOf" in s:
        put("anyOf", any_of(*(sub(x) for x in s["anyOf"])))
    if "oneOf" in s:
        put("oneOf", reduce(lambda a, b: a + b, (sub(x).cast("int") for x in s["oneOf"])) == 1)
    if "not" in s:
        put("not", negate(sub(s["not"])))
    if "if" in s and ("then" in s or "else" in s):
        holds, then, other = sub(s["if"]), sub(s.get("then", True)), sub(s.get("else", True))
        put("if", (~holds | then) & (holds | other))
    if "$ref" in s:
        inner = scope.enter(s["$ref"])
        put("$ref", all_of(*(c for _, _, c in _checks(resolve(scope.root, s["$ref"]), v, pointer, inner))) if inner else F.when(v.col.isNull(), True).otherwise(F.lit(None).cast(_UNDECIDED)))
    return out


def _object_checks(s, v, obj, sub, put, out, pointer, scope) -> None:
    if "required" in s:
        put("required", implies(obj, all_of(*(v.has(k) for k in s["required"]))))
    for k, needs in s.get("dependentRequired", {}).items():
        put("dependentRequired", implies(obj, implies(v.has(k), all_of(*(v.has(x) for x in needs)))))
    for k, x in s.get("dependentSchemas", {}).items():
        put("dependentSchemas", implies(obj, implies(v.has(k), sub(x))))
    for k, x in s.get("properties", {}).items():
        inner = v.get(k)
        if inner is not None:
            for keyword, at, check in _checks(x, inner, f"{pointer}/properties/{pointer_token(k)}", scope):
                out.append((keyword, at, implies(all_of(obj, v.has(k)), check)))
    patterns = s.get("patternProperties", {})
    for p, x in patterns.items():
        put("patternProperties", implies(obj, v.each_entry(lambda key, inner, p=p, x=x: implies(_matches(key, p), sub(x, inner)))))
    if "additionalProperties" in s:
        known = lambda key: any_of(key.isin(*s["properties"]) if s.get("properties") else False, *(_matches(key, p) for p in patterns))
        put("additionalProperties", implies(obj, v.each_entry(lambda key, inner: any_of(known(key), sub(s["additionalProperties"], inner)))))
    if "propertyNames" in s:
        put("propertyNames", implies(obj, F.forall(v.keys(), lambda key: sub(s["propertyNames"], Typed(key, T.StringType())))))
    if "minProperties" in s:
        put("minProperties", implies(obj, col_of(F.size(v.keys()) >= s["minProperties"])))
    if "maxProperties" in s:
        put("maxProperties", implies(obj, col_of(F.size(v.keys()) <= s["maxProperties"])))
    if "unevaluatedProperties" in s:
        seen = evaluated({k: x for k, x in s.items() if k != "unevaluatedProperties"}, v, sub, scope, keys=True)
        put("unevaluatedProperties", implies(obj, v.each_entry(lambda key, inner: any_of(F.array_contains(seen, key), sub(s["unevaluatedProperties"], inner)))))


def _array_checks(s, v, arr, sub, put, scope) -> None:
    items, prefix = v.items(), s.get("prefixItems", [])
    for i, x in enumerate(prefix):
        put("prefixItems", implies(arr, implies(col_of(F.size(items) > i), sub(x, v.item(F.get(items, F.lit(i)))))))
    if "items" in s:
        tail = F.slice(items, len(prefix) + 1, F.greatest(F.size(items), F.lit(1))) if prefix else items
        put("items", implies(arr, F.forall(tail, lambda e: sub(s["items"], v.item(e)))))
    if "minItems" in s:
        put("minItems", implies(arr, col_of(F.size(items) >= s["minItems"])))
    if "maxItems" in s:
        put("maxItems", implies(arr, col_of(F.size(items) <= s["maxItems"])))
    if s.get("uniqueItems"):
        put("uniqueItems", implies(arr, col_of(F.size(F.array_distinct(F.transform(items, lambda e: v.item(e).canonical()))) == F.size(items))))
    if "contains" in s:
        before = len(scope.cuts)
        at_least = F.size(F.filter(items, lambda e: sub(s["contains"], v.item(e))))
        enough = lambda n: (n >= s.get("minContains", 1)) & (n <= s["maxContains"] if "maxContains" in s else F.lit(True))
        check = col_of(enough(at_least))
        if len(scope.cuts) > before:  # items that are not decided may count or not
            at_most = F.size(F.filter(items, lambda e: F.coalesce(sub(s["contains"], v.item(e)), F.lit(True))))
            check = F.when(at_least == at_most, check)
        put("contains", implies(arr, check))
    if "unevaluatedItems" in s:
        seen = evaluated({k: x for k, x in s.items() if k != "unevaluatedItems"}, v, sub, scope, keys=False)
        left = F.filter(F.transform(items, lambda e, i: F.struct(i.alias("i"), e.alias("e"))), lambda x: ~F.array_contains(seen, x["i"]))
        put("unevaluatedItems", implies(arr, F.forall(left, lambda x: sub(s["unevaluatedItems"], v.item(x["e"])))))


def evaluated(s, v: Typed, sub, scope: _Scope, keys: bool) -> Column:
    """Names of properties, or positions of items, that the schema and those of its branches that hold look at."""
    none = F.array().cast("array<string>" if keys else "array<int>")
    every = v.keys() if keys else F.transform(v.items(), lambda _, i: i)
    if not isinstance(s, dict):
        return none
    inner = lambda x: evaluated(x, v, sub, scope, keys)
    parts = [none]
    if keys:
        if s.get("properties"):
            parts.append(F.array(*map(F.lit, s["properties"])))
        if "additionalProperties" in s or "unevaluatedProperties" in s:
            parts.append(every)
        for p in s.get("patternProperties", {}):
            parts.append(F.filter(every, lambda key, p=p: _matches(key, p)))
        for k, x in s.get("dependentSchemas", {}).items():
            parts.append(F.when(col_of(v.has(k)), inner(x)).otherwise(none))
    else:
        if "items" in s or "unevaluatedItems" in s:
            parts.append(every)
        if s.get("prefixItems"):
            parts.append(F.array(*map(F.lit, range(len(s["prefixItems"])))))
        if "contains" in s:
            parts.append(F.filter(every, lambda i: sub(s["contains"], v.item(F.get(v.items(), i)))))
    if "$ref" in s and (within := scope.enter(s["$ref"])):
        parts.append(evaluated(resolve(scope.root, s["$ref"]), v, lambda x, y=v: _whole(x, y, within), within, keys))
    parts += [inner(x) for x in s.get("allOf", [])]
    parts += [F.when(sub(x), inner(x)).otherwise(none) for x in [*s.get("anyOf", []), *s.get("oneOf", [])]]
    if "if" in s:
        then, other = (inner(s.get(k, True)) for k in ("then", "else"))
        parts.append(F.when(sub(s["if"]), F.array_union(inner(s["if"]), then)).otherwise(other))
    return reduce(F.array_union, parts)
