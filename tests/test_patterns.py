"""Texts for patterns: every one is found by the pattern and keeps the bounds of length."""

import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pactlake.functions.pattern_text import matching_text, pattern_text, python_pattern
from pactlake.operators import generate, registry_generation

#: pattern, least, most, whether there is a text.
CASES = [
    ("^[a-z]+$", 0, None, True), ("^(?:ab|cde){2,3}x?$", 7, 9, True), ("abc", 20, 22, True), ("^[A-Z]{2}\\d{3,5}-(foo|bar)$", 0, None, True), ("(?=.*\\d)^[a-z0-9]{8,}$", 0, None, True), ("^\\cC$", 1, 1, True),
    ("^(a*)*$", 3, 3, True), ("^[^a-z]{3}$", 0, None, True), ("^\\w+@\\w+\\.(com|org)$", 0, 12, True), ("^.{2000,}$", 0, None, True), ("^(?:a|bb|){3}$", 5, 5, True), ("^(?<y>\\d{4})-(?<m>0[1-9]|1[0-2])$", 0, None, True), ("^a|b$", 0, None, True),
    ("^a|z$", 3, 9, True), ("ab|^ac$|ad", 5, 6, True), ("", 4, 4, True), ("^$", 0, None, True), ("^[\u0430-\u044f]{2,}$", 0, None, True), ("^(ab){1,500}$", 900, None, True), ("^\\S\\D\\W\\.$", 0, None, True), ("^(?:x{2}){0,2}$", 0, 1, True), ("\\bcat\\b", 0, None, True),
    ("^a$", 2, None, False), ("^a{5}$", 0, 4, False), ("[", 0, None, False), ("^(a)\\1$", 0, None, False), ("(?!)", 0, None, False), ("^(?:aa)*$", 3, 3, False), (None, 0, None, False),
]


@pytest.mark.parametrize("pattern,least,most,there", CASES)
def test_texts_match_and_keep_their_length(pattern, least, most, there):
    made = [matching_text(pattern, least, most, seed) for seed in range(20)]
    assert all((m is not None) == there for m in made)
    for m in made if there else ():
        assert re.search(python_pattern(pattern), m) and len(m) >= least and (most is None or len(m) <= most)
    assert made == [matching_text(pattern, least, most, seed) for seed in range(20)]


_atoms = st.sampled_from(["a", "[b-d]", "\\d", "[^x]", ".", "\\.", "é"])
_patterns = st.recursive(_atoms, lambda p: st.one_of(st.builds(lambda x, y: x + y, p, p), st.builds(lambda x, y: f"(?:{x}|{y})", p, p), st.builds(lambda x, q: f"(?:{x}){q}", p, st.sampled_from(["?", "*", "+", "{2}", "{1,3}", "{2,}"]))), max_leaves=6)


@settings(max_examples=150, deadline=None)
@given(_patterns, st.integers(0, 6), st.integers(0, 6), st.integers(0, 2**40))
def test_any_pattern(pattern, least, more, seed):
    whole = f"^{pattern}$"
    made = matching_text(whole, least, least + more, seed)
    if made is None:  # no text of these lengths: then none of the first letters make one either
        assert not any(re.fullmatch(pattern, c * n) for c in "ab1.é" for n in range(least, least + more + 1))
    else:
        assert re.fullmatch(pattern, made) and least <= len(made) <= least + more


def test_texts_as_a_column(spark):
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, pattern string, least int, most int, there boolean")
    got = rows.select("i", "there", pattern_text("pattern", "least", "most", F.xxhash64("i")).alias("text")).collect()
    assert [r.i for r in got if (r.text is not None) != r.there] == [] and len(got) == len(CASES)
    assert rows.limit(0).select(pattern_text("pattern", "least", "most", F.xxhash64("i"))).count() == 0


def test_values_with_patterns(spark):
    contract = {"type": "object", "properties": {"a": {"pattern": "^[A-Z]{2}-\\d{3,6}$", "type": "string"}, "b": {"pattern": "^\"\\\\[\\t ]x{3,}$", "maxLength": 8}}, "required": ["a", "b"]}
    rows = generate.generate(spark, contract, 40, attempts=4).collect()
    assert all(r.status == "found" for r in rows) and len({r.value for r in rows}) > 30
    for r in rows:
        v = json.loads(r.value)
        assert re.fullmatch(r"[A-Z]{2}-\d{3,6}", v["a"]) and re.fullmatch(r'"\\[\t ]x{3,}', v["b"]) and len(v["b"]) <= 8


def test_formats(spark):
    want = {"time": r"([01]\d|2[0-3]):[0-5]\d:[0-5]\dZ", "ipv6": r"([0-9a-f]{4}:){7}[0-9a-f]{4}", "ipv4": r"(\d{1,3}\.){3}\d{1,3}"}
    for name, form in want.items():
        assert all(re.fullmatch(form, json.loads(r.value)) for r in generate.generate(spark, {"type": "string", "format": name}, 20, attempts=1).collect()), name


def test_patterns_of_contracts_as_rows(spark):
    long = "^[a-f0-9]{30,}z$"
    contracts = [(0, {"type": "string", "pattern": long}), (1, {"properties": {"k": {"type": "string", "pattern": "^[A-Z]+$", "minLength": 5}}, "required": ["k"], "type": "object"}), (2, {"type": "string", "pattern": "^a$", "minLength": 2})]
    reg = spark.createDataFrame([(i, json.dumps(c)) for i, c in contracts], "c int, schema_json string")
    got = {r.c: r for r in registry_generation.generate_registered(reg, ["c"], attempts=(4, 8)).collect()}
    assert re.search(long, json.loads(got[0].value)) and re.fullmatch("[A-Z]{5,}", json.loads(got[1].value)["k"])
    assert (got[2].status, got[2].value, got[2].tried) == ("exhausted", None, 12)
    pair = spark.createDataFrame([(0, "both", json.dumps({"type": "string", "pattern": "^[0-9]{3}$"}), json.dumps({"type": "string", "pattern": "^[a-z]{9,}$"}))], "p int, role string, old string, new string")
    shown = {r.direction: json.loads(r.witness) for r in registry_generation.counterexamples(pair, ["p"], attempts=(4,)).collect()}
    assert re.fullmatch("[a-z]{9,}", shown["serializer"]) and re.fullmatch("[0-9]{3}", shown["deserializer"])
