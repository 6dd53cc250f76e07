"""Pairs of API descriptions, each a change that a reader of the old one may or may not survive."""

import json

from pyspark.sql import functions as F

from pactlake.operators import openapi

INT, TEXT, OBJ = {"type": "integer"}, {"type": "string"}, {"type": "object"}


def doc(op=None, path="/a", method="post", components=None, item=None):
    return {"openapi": "3.1.0", "components": components or {}, "paths": {path: {method: {"responses": {"200": {}}} | (op or {}), **(item or {})}}}


def asks(media, required=False):
    return {"requestBody": {"required": required, "content": {k: {"schema": v} for k, v in media.items()}}}


def tells(**entries):
    return {"responses": {k.strip("_"): v for k, v in entries.items()}}


def content(**media):
    return {"content": {k.replace("_", "/").replace("ANY", "*"): {"schema": v} for k, v in media.items()}}


def query(name, required=False, **schema):
    return {"parameters": [{"in": "query", "name": name, "required": required, "schema": schema}]}


JSON = "application/json"
#: name: old, new, the issues.
PAIRS = {
    "nothing": (doc(), doc(), []),
    "operation removed": (doc(), doc(method="get"), ["POST /a was removed"]),
    "operation added": (doc(), doc(item={"get": {"responses": {}}}), []),
    "required body where there was none": (doc(), doc(asks({JSON: OBJ}, True)), ["POST /a request body: requires a body"]),
    "optional body where there was none": (doc(), doc(asks({JSON: OBJ})), []),
    "body dropped": (doc(asks({JSON: OBJ}, True)), doc(), ["POST /a request body: no longer accepts application/json"]),
    "body becomes required": (doc(asks({JSON: OBJ})), doc(asks({JSON: OBJ}, True)), ["POST /a request body: requires a body"]),
    "body becomes optional": (doc(asks({JSON: OBJ}, True)), doc(asks({JSON: OBJ})), []),
    "response content dropped": (doc(tells(_200=content(application_json=OBJ))), doc(tells(_200={})), ["POST /a response body of 200: may come without a body"]),
    "response content where there was none": (doc(tells(_200={})), doc(tells(_200=content(application_json=OBJ))), ["POST /a response body of 200: answers with application/json"]),
    "new status without content": (doc(tells(_200={})), doc(tells(_200={}, _404={})), ["POST /a response: answers with status 404"]),
    "status dropped": (doc(tells(_200={}, _404={})), doc(tells(_200={})), []),
    "class and a status of another schema": (doc(tells(**{"2XX": content(application_json=INT)})), doc(tells(_200=content(application_json=TEXT))), ["POST /a response body of 200: application/json incompatible"]),
    "class and a status of a narrower schema": (doc(tells(**{"2XX": content(application_json={"type": "number"})})), doc(tells(_200=content(application_json=INT), _204=content(application_json=INT))), []),
    "status instead of a class": (doc(tells(_200={})), doc(tells(**{"2XX": {}})), ["POST /a response: answers with status 2XX"]),
    "default beyond the listed": (doc(tells(_200={}, _404=content(application_json=TEXT))), doc(tells(_200={}, default=content(application_json=TEXT))), ["POST /a response: answers with status default"]),
    "classes instead of default": (doc(tells(default={})), doc(tells(**{f"{i}XX": {} for i in range(1, 6)})), []),
    "default instead of all classes": (doc(tells(**{f"{i}XX": {} for i in range(1, 6)})), doc(tells(default={})), []),
    "default of another schema under a class": (doc(tells(default=content(application_json=INT))), doc(tells(default=content(application_json=INT), **{"4XX": content(application_json=TEXT)})), ["POST /a response body of 4XX: application/json incompatible"]),
    "media type and a range of another schema": (doc(asks({JSON: OBJ})), doc(asks({"application/*": TEXT})), ["POST /a request body: application/json incompatible"]),
    "media type and a range of a wider schema": (doc(asks({JSON: INT})), doc(asks({"application/*": {}})), []),
    "range and one of its types": (doc(asks({"text/*": TEXT})), doc(asks({"text/plain": TEXT})), ["POST /a request body: no longer accepts text/*"]),
    "range beside a narrower type": (doc(asks({"text/*": TEXT})), doc(asks({"text/*": TEXT, "text/plain": INT})), ["POST /a request body: text/plain incompatible"]),
    "any type and what it leaves": (doc(asks({"*/*": TEXT, JSON: INT})), doc(asks({"*/*": TEXT, "application/*": TEXT})), ["POST /a request body: application/json incompatible"]),
    "parameters of media types": (doc(asks({"Text/Plain; charset=x": TEXT})), doc(asks({"text/plain": TEXT})), []),
    "answer in a type of an old range": (doc(tells(_200=content(text_ANY=TEXT))), doc(tells(_200=content(text_plain=TEXT))), []),
    "answer in a range": (doc(tells(_200=content(text_plain=TEXT))), doc(tells(_200=content(text_ANY=TEXT))), ["POST /a response body of 200: answers with text/*"]),
    "required query parameter": (doc(), doc(query("q", True, type="string")), ["POST /a request query: requires q"]),
    "optional query parameter": (doc(), doc(query("q", type="string")), []),
    "query parameter gone": (doc(query("q", type="string")), doc(), ["POST /a request query: no longer accepts q"]),
    "enum narrowed": (doc(query("q", enum=["x", "y"])), doc(query("q", enum=["x"])), ["POST /a request query: q incompatible"]),
    "header widened": (doc(tells(_200={"headers": {"X": {"schema": {"type": "string", "maxLength": 3}}}})), doc(tells(_200={"headers": {"x": {"schema": TEXT}}})), ["POST /a response headers of 200: x incompatible"]),
    "header added": (doc(tells(_200={})), doc(tells(_200={"headers": {"X": {}}})), ["POST /a response headers of 200: answers with x"]),
    "required header under a class": (doc(tells(**{"2XX": {"headers": {"X": {"required": True}}}})), doc(tells(_201={"headers": {"X": {}}})), ["POST /a response headers of 201: may lack x"]),
    "closed answer with more room": (doc(tells(_200=content(application_json={"type": "object", "properties": {"a": INT}, "additionalProperties": False, "maxProperties": 1}))), doc(tells(_200=content(application_json={"type": "object", "properties": {"a": INT}, "additionalProperties": False, "maxProperties": 3}))), []),
    "field of an alternative required": (doc(asks({JSON: {"anyOf": [{"type": "object", "properties": {"a": TEXT}}]}})), doc(asks({JSON: {"anyOf": [{"type": "object", "properties": {"a": TEXT}, "required": ["a"]}]}})), ["POST /a request body: application/json incompatible"]),
    "schema behind a reference": (doc(asks({JSON: {"$ref": "#/components/schemas/S"}}), components={"schemas": {"S": {"minimum": 1}}}), doc(asks({JSON: {"$ref": "#/components/schemas/S"}}), components={"schemas": {"S": {"minimum": 2}}}), ["POST /a request body: application/json incompatible"]),
}


def test_changes_of_descriptions(spark):
    old, new = (spark.createDataFrame([(k, json.dumps(p[i])) for k, p in PAIRS.items()], "pair string, doc_json string") for i in (0, 1))
    got = {r.pair: r for r in openapi.report(old, new, ["pair"]).collect()}
    assert {k: (got[k].issues, p[2]) for k, p in PAIRS.items() if got[k].issues != p[2]} == {}
    assert all(got[k].is_compatible == (not p[2]) == (got[k].n == 0) for k, p in PAIRS.items())


def test_cells_of_statuses(spark):
    codes = [str(i) for i in range(200, 300)]
    rows = [(["200", "2XX", "default"], ["404"], {"200", "2XX", "404", "default"}), (codes, ["2XX"], {*codes}), ([*openapi.CLASSES], ["default"], {*openapi.CLASSES}), ([], [], set())]
    df = spark.createDataFrame([(o, n) for o, n, _ in rows], "o array<string>, n array<string>").select(openapi.status_cells(F.col("o"), F.col("n")).alias("cells"))
    assert [set(r.cells) for r in df.collect()] == [w for _, _, w in rows]
