"""Contracts compiled to column expressions over a VARIANT, inside code generation.

``compile_contract`` covers type, enum and const (of scalars), required, properties,
items, additionalProperties (true or false), the string, number, array and object
bounds, pattern, the date, date-time, uri and uri-reference formats, allOf, anyOf,
not and if/then/else.  ``None`` for a contract with anything else: it goes to the
evaluator instead, whose violations are the same.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from metaloom.functions.pointers import escape
from metaloom.functions.values import number_text

VIOLATION = "struct<path:string,keyword:string,message:string,subject:string>"

_ANNOTATIONS = {"$schema", "$id", "title", "description", "default", "examples", "$comment", "deprecated", "readOnly", "writeOnly"}
_RULES = {
    "type", "enum", "const", "required", "properties", "items", "additionalProperties", "minLength", "maxLength", "pattern", "format", "minimum", "maximum",
    "exclusiveMinimum", "exclusiveMaximum", "minItems", "maxItems", "minProperties", "maxProperties", "allOf", "anyOf", "not", "if", "then", "else",
}

_DAY = r"(?:(?:\d{4}-(?:(?:0[13578]|1[02])-(?:0[1-9]|[12]\d|3[01])|(?:0[469]|11)-(?:0[1-9]|[12]\d|30)|02-(?:0[1-9]|1\d|2[0-8])))|(?:(?:\d\d(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)-02-29))"
FORMATS = {
    "date": rf"^{_DAY}$",
    "date-time": rf"^{_DAY}[Tt\s](?:(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?)(?:[Zz]|[+-](?:[01]\d|2[0-3])(?::?[0-5]\d)?)$",
    "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:(?:[!#$&-;=?-\[\]_a-z~A-Z]|%[0-9A-Fa-f]{2})+$",
    "uri-reference": r"^(?:[!#$&-;=?-\[\]_a-z~A-Z]|%[0-9A-Fa-f]{2})*$",
}


def supported(schema: Any) -> bool:
    if isinstance(schema, bool):
        return True
    if not isinstance(schema, dict) or schema.keys() - _ANNOTATIONS - _RULES:
        return False
    if schema.get("format", "date") not in FORMATS or not isinstance(schema.get("additionalProperties", True), bool):
        return False
    scalars = [*schema.get("enum", []), *([schema["const"]] if "const" in schema else [])]
    if any(isinstance(x, dict | list) for x in scalars) or isinstance(schema.get("items"), list):
        return False
    if any(isinstance(schema.get(k), bool) for k in ("exclusiveMinimum", "exclusiveMaximum")):
        return False
    inner = [*schema.get("properties", {}).values(), *(schema[k] for k in ("items", "not", "if", "then", "else") if k in schema), *schema.get("allOf", []), *schema.get("anyOf", [])]
    return all(map(supported, inner))


def _error(path: Column, keyword: str, message: str | Column, subject: str | Column | None = None) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(path.alias("path"), F.lit(keyword).alias("keyword"), text.alias("message"), (subject if isinstance(subject, Column) else F.lit(subject)).cast("string").alias("subject"))


def _none() -> Column:
    return F.array().cast(f"array<{VIOLATION}>")


@dataclass
class _One:
    """One violation, if ``bad`` holds."""

    bad: Column
    error: Column


@dataclass
class _Many:
    """An array of violations; never null."""

    errors: Column


Found = list[_One | _Many]


def _guarded(found: Found, holds: Column) -> Found:
    """The violations that count only where ``holds``, which is never null."""
    return [_One(holds & x.bad, x.error) if isinstance(x, _One) else _Many(F.when(holds, x.errors).otherwise(_none())) for x in found]


def _array(found: Found) -> Column:
    """All violations in order; neighbours that may hold are one array, so that the expression stays small."""
    parts: list[Column] = []
    row: list[Column] = []
    for x in [*found, None]:
        if isinstance(x, _One):
            row.append(F.when(x.bad, x.error))
            continue
        if row:
            parts.append(F.array_compact(F.array(*row)))
            row = []
        if x is not None:
            parts.append(x.errors)
    return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else _none()


def _fails(found: Found) -> Column:
    """Whether there is any violation."""
    out = F.lit(False)
    for x in found:
        out = out | (F.coalesce(x.bad, F.lit(False)) if isinstance(x, _One) else F.size(x.errors) > 0)
    return out


class _Value:
    """A VARIANT and what is asked of it."""

    def __init__(self, variant: Column):
        self.v = variant
        self.kind = F.schema_of_variant(variant)
        self.is_null = self.kind == "VOID"
        self.is_string = self.kind == "STRING"
        self.is_boolean = self.kind == "BOOLEAN"
        self.is_number = self.kind.isin("BIGINT", "DOUBLE", "FLOAT") | self.kind.startswith("DECIMAL")
        self.is_array = self.kind.startswith("ARRAY")
        self.is_object = self.kind.startswith("OBJECT")
        self.text = F.when(self.is_string, F.try_variant_get(variant, "$", "string"))
        self.number = F.when(self.is_number, F.try_variant_get(variant, "$", "double"))
        self.items = F.when(self.is_array, F.try_variant_get(variant, "$", "array<variant>"))
        self.keys = F.when(self.is_object, F.map_keys(F.try_variant_get(variant, "$", "map<string,variant>")))

    def is_type(self, name: str) -> Column:
        if name == "integer":
            return self.is_number & (self.number == F.floor(self.number))
        return {"null": self.is_null, "boolean": self.is_boolean, "number": self.is_number, "string": self.is_string, "array": self.is_array, "object": self.is_object}[name]

    def equals(self, constant: Any) -> Column:
        if constant is None:
            return self.is_null
        if isinstance(constant, bool):
            return self.is_boolean & (F.try_variant_get(self.v, "$", "boolean") == constant)
        if isinstance(constant, str):
            return self.is_string & (self.text == constant)
        return self.is_number & (self.number == float(constant))


def _errors(variant: Column, schema: Any, path: Column) -> Found:
    """Violations of a present value, in the evaluator's order."""
    if schema is True:
        return []
    if schema is False:
        return [_One(F.lit(True), _error(path, "false schema", "boolean schema is false"))]
    x = _Value(variant)
    parts: Found = []
    if "type" in schema:
        names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        good = F.lit(False)
        for n in names:
            good = good | F.coalesce(x.is_type(n), F.lit(False))
        parts.append(_One(~good, _error(path, "type", f"must be {','.join(names)}", ",".join(names))))
    if "enum" in schema:
        good = F.lit(False)
        strings = [c for c in schema["enum"] if isinstance(c, str)]
        if strings:
            good = F.coalesce(x.text.isin(strings), F.lit(False))
        for c in schema["enum"]:
            if not isinstance(c, str):
                good = good | F.coalesce(x.equals(c), F.lit(False))
        parts.append(_One(~good, _error(path, "enum", "must be equal to one of the allowed values")))
    if "const" in schema:
        parts.append(_One(~F.coalesce(x.equals(schema["const"]), F.lit(False)), _error(path, "const", "must be equal to constant")))
    for key, size, noun in (("Length", F.char_length(x.text), "characters"), ("Items", F.size(x.items), "items"), ("Properties", F.size(x.keys), "properties")):
        held = {"Length": x.is_string, "Items": x.is_array, "Properties": x.is_object}[key]
        for edge, more in (("max", "more"), ("min", "fewer")):
            if f"{edge}{key}" in schema:
                limit = schema[f"{edge}{key}"]
                bad = held & ((size > limit) if edge == "max" else (size < limit))
                parts.append(_One(bad, _error(path, f"{edge}{key}", f"must NOT have {more} than {limit} {noun}")))
    if "pattern" in schema:
        parts.append(_One(~x.text.rlike(schema["pattern"]), _error(path, "pattern", f'must match pattern "{schema["pattern"]}"')))
    if "format" in schema:
        name = schema["format"]
        parts.append(_One(~x.text.rlike(FORMATS[name]), _error(path, "format", f'must match format "{name}"', name)))
    for key, sign, bad in (("maximum", "<=", "__gt__"), ("minimum", ">=", "__lt__"), ("exclusiveMaximum", "<", "__ge__"), ("exclusiveMinimum", ">", "__le__")):
        if key in schema:
            parts.append(_One(getattr(x.number, bad)(float(schema[key])), _error(path, key, f"must be {sign} {number_text(schema[key])}")))
    for key in schema.get("required", []):
        parts.append(_One(x.is_object & ~F.array_contains(x.keys, key), _error(path, "required", f"must have required property '{key}'", key)))
    for key, rule in schema.get("properties", {}).items():
        quoted = key.replace("\\", "\\\\").replace("'", "\\'")
        child = F.try_variant_get(variant, f"$['{quoted}']", "variant")
        found = _errors(child, rule, F.concat(path, F.lit(f"/{escape(key)}")))
        parts += _guarded(found, child.isNotNull())
    if schema.get("additionalProperties") is False:
        extra = F.array_except(x.keys, F.array(*[F.lit(k) for k in schema.get("properties", {})]) if schema.get("properties") else F.array().cast("array<string>"))
        each = F.transform(extra, lambda k: _error(path, "additionalProperties", F.concat(F.lit("must NOT have additional property '"), k, F.lit("'")), k))
        parts.append(_Many(F.coalesce(each, _none())))
    if "items" in schema:
        each = F.transform(x.items, lambda item, i: _array(_errors(item, schema["items"], F.concat(path, F.lit("/"), i.cast("string")))))
        parts.append(_Many(F.coalesce(F.flatten(each), _none())))
    for part in schema.get("allOf", []):
        parts += _errors(variant, part, path)
    if "anyOf" in schema:
        branches = [_errors(variant, part, path) for part in schema["anyOf"]]
        none = F.lit(True)
        for b in branches:
            none = none & _fails(b)
        own = _One(F.lit(True), _error(path, "anyOf", "must match a schema in anyOf"))
        parts += _guarded([*(x for b in branches for x in b), own], none)
    if "not" in schema:
        parts.append(_One(~_fails(_errors(variant, schema["not"], path)), _error(path, "not", "must NOT be valid")))
    if "if" in schema and ("then" in schema or "else" in schema):
        holds = ~_fails(_errors(variant, schema["if"], path))
        for branch, taken in (("then", holds), ("else", ~holds)):
            found = _errors(variant, schema.get(branch, True), path)
            parts += _guarded([*found, _One(_fails(found), _error(path, "if", f'must match "{branch}" schema'))], taken)
    return parts


def compile_contract(schema: Any, variant: Column) -> Column | None:
    """An array of violations of a VARIANT column; None if the contract needs the evaluator."""
    return _array(_errors(variant, schema, F.lit(""))) if supported(schema) else None
