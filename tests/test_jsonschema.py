"""The evaluator, keyword by keyword, and the compiled form against it."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from metaloom.functions.values import Moment
from metaloom.operators.compile import compile_contract, supported
from metaloom.operators.jsonschema import Evaluator, SchemaError, is_date_time, is_uri
from metaloom.sources.builtins import BUILTINS
from metaloom.sources.registry import Registry, check_pin, classify, digest, parse_contract


def errors(schema, value, registry=None):
    return [(v.path, v.keyword, v.subject) for v in Evaluator(schema, registry).evaluate(value)]


@pytest.mark.parametrize(
    ("schema", "good", "bad", "keyword"),
    [
        ({"type": "integer"}, 2.0, 2.5, "type"),
        ({"type": ["string", "null"]}, None, 1, "type"),
        ({"enum": [1, "a", {"x": [1]}]}, {"x": [1.0]}, {"x": []}, "enum"),
        ({"const": {"a": 1, "b": 2}}, {"b": 2, "a": 1}, {"a": 1}, "const"),
        ({"minLength": 2}, "éé", "é", "minLength"),
        ({"maxLength": 1}, "\U0001f600", "ab", "maxLength"),
        ({"pattern": "b+"}, "abc", "ac", "pattern"),
        ({"format": "date-time"}, "2024-02-29T10:00:00+01:00", "2023-02-29T10:00:00Z", "format"),
        ({"format": "uri"}, "https://a.b/c", "no scheme", "format"),
        ({"format": "never-heard-of"}, "x", None, None),
        ({"minimum": 2}, 2, 1, "minimum"),
        ({"exclusiveMinimum": 2}, 3, 2, "exclusiveMinimum"),
        ({"maximum": 2}, 2, 3, "maximum"),
        ({"exclusiveMaximum": 2}, 1, 2, "exclusiveMaximum"),
        ({"multipleOf": 0.1}, 0.3, 0.35, "multipleOf"),
        ({"items": {"type": "string"}}, ["a"], ["a", 1], "type"),
        ({"prefixItems": [{"type": "string"}], "items": False}, ["a"], ["a", 1], "false schema"),
        ({"contains": {"const": 1}}, [0, 1], [0], "contains"),
        ({"contains": {"const": 1}, "minContains": 2}, [1, 1], [1], "contains"),
        ({"contains": {"const": 1}, "maxContains": 1}, [1], [1, 1], "contains"),
        ({"minItems": 1}, [0], [], "minItems"),
        ({"maxItems": 1}, [0], [0, 0], "maxItems"),
        ({"uniqueItems": True}, [1, "1"], [1, 1.0], "uniqueItems"),
        ({"required": ["a"]}, {"a": None}, {}, "required"),
        ({"additionalProperties": False, "properties": {"a": {}}}, {"a": 1}, {"b": 1}, "additionalProperties"),
        ({"patternProperties": {"^x": {"type": "number"}}}, {"x1": 1, "y": ""}, {"x1": ""}, "type"),
        ({"propertyNames": {"maxLength": 1}}, {"a": 1}, {"ab": 1}, "maxLength"),
        ({"minProperties": 1}, {"a": 1}, {}, "minProperties"),
        ({"maxProperties": 1}, {"a": 1}, {"a": 1, "b": 1}, "maxProperties"),
        ({"dependentRequired": {"a": ["b"]}}, {"a": 1, "b": 1}, {"a": 1}, "dependentRequired"),
        ({"dependentSchemas": {"a": {"required": ["b"]}}}, {"b": 1}, {"a": 1}, "required"),
        ({"$schema": "http://json-schema.org/draft-07/schema#", "dependencies": {"a": ["b"]}}, {}, {"a": 1}, "dependencies"),
        ({"allOf": [{"minimum": 1}, {"maximum": 2}]}, 2, 3, "maximum"),
        ({"anyOf": [{"type": "string"}, {"type": "null"}]}, None, 1, "anyOf"),
        ({"oneOf": [{"type": "number"}, {"minimum": 5}]}, 1, 6, "oneOf"),
        ({"not": {"type": "string"}}, 1, "a", "not"),
        ({"if": {"const": 1}, "then": False, "else": {"type": "number"}}, 2, 1, "if"),
        ({"$ref": "#/$defs/a", "$defs": {"a": {"minimum": 1}}}, 1, 0, "minimum"),
        ({"$schema": "http://json-schema.org/draft-04/schema#", "minimum": 1, "exclusiveMinimum": True}, 2, 1, "minimum"),
        ({"properties": {"a": {}}, "unevaluatedProperties": False}, {"a": 1}, {"b": 1}, "unevaluatedProperties"),
        ({"prefixItems": [{}], "unevaluatedItems": False}, [1], [1, 2], "unevaluatedItems"),
        ({"allOf": [{"properties": {"a": {}}}], "unevaluatedProperties": False}, {"a": 1}, {"a": 1, "c": 1}, "unevaluatedProperties"),
    ],
)
def test_keyword(schema, good, bad, keyword):
    assert errors(schema, good) == []
    if keyword:
        assert keyword in [k for _, k, _ in errors(schema, bad)]


def test_all_errors_are_reported_with_subjects():
    schema = {"required": ["title"], "additionalProperties": False, "properties": {"slug": {"minLength": 5, "pattern": "^[a-z]+$"}, "when": {"format": "date-time"}, "n": {"type": ["number", "null"]}}}
    got = errors(schema, {"slug": "A1", "when": "x", "n": "y", "more": 1})
    assert sorted(got, key=str) == sorted([("", "required", "title"), ("/slug", "minLength", None), ("/slug", "pattern", None), ("/when", "format", "date-time"), ("/n", "type", "number,null"), ("", "additionalProperties", "more")], key=str)


def test_keywords_of_other_types_do_not_bind():
    assert errors({"properties": {"a": {}}, "required": ["a"], "minLength": 9, "items": False}, 5) == []
    assert errors({"type": "object", "properties": {"last": BUILTINS["docusaurus:docs:3.10"]["properties"]["last_update"]}}, {"last": {}}) == [("/last", "minProperties", None)]


def test_dates_of_toml_are_no_strings():
    assert errors({"properties": {"d": {"type": "string"}}}, {"d": Moment("2024-01-01")}) == [("/d", "type", "string")]


def test_references():
    other = {"$id": "other", "type": "string"}
    assert errors({"$ref": "other"}, 1, {"other": other}) == [("", "type", "string")]
    with pytest.raises(SchemaError, match="can't resolve"):
        Evaluator({"$ref": "https://example.com/x.json"})
    tree = {"$defs": {"n": {"properties": {"kids": {"items": {"$ref": "#/$defs/n"}}, "v": {"type": "number"}}}}, "$ref": "#/$defs/n"}
    assert errors(tree, {"kids": [{"kids": [{"v": "x"}]}]}) == [("/kids/0/kids/0/v", "type", "number")]


def test_builtins():
    registry = Registry()
    check = lambda ref, data: [(v.path, v.keyword) for v in registry.compile(ref).evaluate(data)]
    assert check("google:okf:0.1", {"title": "x"}) == [("", "required")]
    assert check("diataxis:diataxis:1.0", {"type": "howto"}) == [("/type", "enum")]
    assert ("/unlisted", "const") in check("docusaurus:docs:3.10", {"draft": True, "unlisted": True})
    assert check("docusaurus:blog:3.10", {"authors": 5}) == [("/authors", "type")]
    assert check("docusaurus:blog:3.10", {"authors": [{"url": "a b"}]}) == [("/authors/0/url", "format")]
    assert len(BUILTINS["tgdp:templates:1.0"]["properties"]["type"]["enum"]) == 25


def test_formats():
    assert is_date_time("1990-12-31T23:59:60Z") and not is_date_time("1990-12-31T22:59:60Z") and is_date_time("2024-01-01 00:00:00+00:00")
    assert not is_date_time("2024-01-01") and is_uri("urn:x:y") and not is_uri("https://a b")


def test_registry(tmp_path):
    (tmp_path / "a.json").write_text('\ufeff{"type": "object"}', encoding="utf-8")
    registry = Registry(str(tmp_path), fetch=lambda url: b'{"title": "no keyword"}')
    assert registry.load("a.json") == {"type": "object"}
    with pytest.raises(SchemaError, match="no JSON Schema"):
        registry.load("https://example.com/x.json")
    with pytest.raises(SchemaError, match="unknown built-in"):
        registry.load("a:b:c")
    with pytest.raises(SchemaError, match="line 1, column"):
        parse_contract("{", "x")
    raw = (tmp_path / "a.json").read_bytes()
    check_pin(raw, digest(raw), "a")
    with pytest.raises(SchemaError, match="line endings"):
        check_pin(b"a\r\n", digest(b"a\n"), "a")
    assert [classify(x) for x in ("https://x", "a:b:1.0", "c:\\x", "./a:b:c", "x.json")] == ["url", "builtin", "file", "file", "file"]


COMPILED = [
    {k: v for k, v in BUILTINS["google:okf:0.1"].items()},
    BUILTINS["docusaurus:docs:3.10"],
    {
        "type": "object",
        "required": ["a"],
        "additionalProperties": False,
        "properties": {
            "a": {"type": ["string", "integer"], "minLength": 2, "maximum": 5, "enum": ["ab", "x", 3, None]},
            "b": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "number", "exclusiveMinimum": 0}},
            "c": {"anyOf": [{"const": True}, {"pattern": "^z"}]},
            "tags": {"not": {"type": "string"}},
        },
    },
]

scalars = st.one_of(st.none(), st.booleans(), st.integers(-3, 9), st.sampled_from([0.5, 2.0, 3.0]), st.sampled_from(["", "ab", "x", "zz", "a b", "https://x.y/z", "2024-01-01T00:00:00Z"]))
keys = st.sampled_from(["a", "b", "c", "type", "title", "resource", "tags", "timestamp", "draft", "unlisted", "toc_min_heading_level", "image", "last_update", "~/"])
values = st.one_of(scalars, st.lists(scalars, max_size=3), st.dictionaries(st.sampled_from(["author", "date", "label", "permalink", "x"]), scalars, max_size=2))
documents = st.dictionaries(keys, values, max_size=5)


@settings(max_examples=1, deadline=None)
@given(st.lists(documents, min_size=150, max_size=150))
def test_compiled_contracts_agree_with_the_evaluator(spark, data):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(data)], "i int, j string")
    for schema in COMPILED:
        assert supported(schema)
        got = rows.select("i", compile_contract(schema, F.parse_json("j")).alias("e")).collect()
        for r in got:
            want = sorted((v.path, v.keyword, v.message, v.subject or "") for v in Evaluator(schema).evaluate(data[r["i"]]))
            assert sorted((e["path"], e["keyword"], e["message"], e["subject"] or "") for e in r["e"]) == want, data[r["i"]]


def test_what_does_not_compile():
    assert not supported({"oneOf": []}) and not supported({"$ref": "#"}) and not supported({"enum": [[1]]})
