"""A query for the whole keyword vocabulary: one small contract for each keyword, against documents of every supplier.

Each case has its contract and, for the SQL, the keywords of its violations as a list of
(condition, keyword) over ``k`` (key), ``n`` (nation), ``b`` (balance), ``nm`` (name) and ``t`` (number of tags).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.operators import extract as X
from metaloom.operators import resolve as S
from metaloom.operators import validate as V
from metaloom.sources.registry import Registry

from . import rendering as R

DRAFT7 = "http://json-schema.org/draft-07/schema#"
D2019 = "https://json-schema.org/draft/2019-09/schema"
D2020 = "https://json-schema.org/draft/2020-12/schema"


def _of(field: str, rule: object, **more: object) -> dict:
    return {"properties": {field: rule}, **more}


_SMALL = {"maximum": 50}

CASES: dict[str, tuple[dict, list[tuple[str, str]]]] = {
    "ref": (_of("key", {"$ref": "#/$defs/small"}, **{"$defs": {"small": _SMALL}}), [("k > 50", "maximum")]),
    "definitions": (_of("key", {"$ref": "#/definitions/small"}, definitions={"small": _SMALL}), [("k > 50", "maximum")]),
    "id": (_of("key", {"$ref": "https://x.test/id.json#/$defs/small"}, **{"$id": "https://x.test/id.json", "$defs": {"small": _SMALL}}), [("k > 50", "maximum")]),
    "schema_draft7": ({"$schema": DRAFT7, "properties": {"pair": {"items": [{"maximum": 10}, {"maximum": 10}]}}}, [("n > 10 OR k % 25 > 10", "maximum")]),
    "dynamic_ref": (_of("key", {"$dynamicRef": "#small"}, **{"$schema": D2020, "$defs": {"small": {"$dynamicAnchor": "small", "maximum": 50}}}), [("k > 50", "maximum")]),
    "recursive_ref": ({"$schema": D2019, "properties": {"key": {"maximum": 50}, "site": {"$recursiveRef": "#"}}}, [("k > 50", "maximum")]),
    "all_of": ({"allOf": [_of("key", {"maximum": 80}), _of("nation", {"minimum": 5})]}, [("k > 80", "maximum"), ("n < 5", "minimum")]),
    "any_of": ({"anyOf": [_of("key", {"maximum": 20}), _of("nation", {"minimum": 12})]}, [("k > 20 AND n < 12", "anyOf"), ("k > 20 AND n < 12", "maximum"), ("k > 20 AND n < 12", "minimum")]),
    "one_of": ({"oneOf": [_of("key", {"maximum": 20}), _of("nation", {"minimum": 12})]}, [("(k > 20 AND n < 12)", "maximum"), ("(k > 20 AND n < 12)", "minimum"), ("(k > 20) = (n < 12)", "oneOf")]),
    "not": ({"not": _of("nation", {"maximum": 7})}, [("n <= 7", "not")]),
    "if_then_else": ({"if": _of("key", {"maximum": 50}), "then": _of("nation", {"minimum": 8}), "else": _of("nation", {"maximum": 16})}, [("k <= 50 AND n < 8 OR k > 50 AND n > 16", "if"), ("k > 50 AND n > 16", "maximum"), ("k <= 50 AND n < 8", "minimum")]),
    "dependent_schemas": ({"dependentSchemas": {"extra": _of("nation", {"maximum": 12})}}, [("k % 4 = 0 AND n > 12", "maximum")]),
    "dependencies": ({"$schema": DRAFT7, "dependencies": {"extra": ["rare"]}}, [("k % 4 = 0 AND k % 8 <> 0", "dependencies")]),
    "dependent_required": ({"dependentRequired": {"extra": ["rare"]}}, [("k % 4 = 0 AND k % 8 <> 0", "dependentRequired")]),
    "type": (_of("mixed", {"type": "integer"}), [("k % 3 = 0", "type")]),
    "required": ({"required": ["extra"]}, [("k % 4 <> 0", "required")]),
    "additional_properties": ({"properties": dict.fromkeys(("key", "name", "nation", "balance", "tags", "pair", "site", "mixed", "date", "rare"), True), "additionalProperties": False}, [("k % 4 = 0", "additionalProperties")]),
    "pattern_properties": ({"patternProperties": {"^n": {"type": "string"}}}, [("true", "type")]),
    "property_names": ({"propertyNames": {"maxLength": 4}}, [("true", "maxLength"), ("true", "propertyNames")]),
    "unevaluated_properties": ({"$schema": D2020, "allOf": [{"properties": dict.fromkeys(("key", "name", "nation", "balance", "tags", "pair", "site", "mixed", "date"), True)}], "unevaluatedProperties": False}, [("k % 4 = 0", "unevaluatedProperties")]),
    "min_properties": ({"minProperties": 10}, [("k % 4 <> 0", "minProperties")]),
    "max_properties": ({"maxProperties": 9}, [("k % 4 = 0", "maxProperties")]),
    "items": (_of("tags", {"items": {"maximum": 2}}), [("t > 2", "maximum")]),
    "prefix_items": ({"$schema": D2020, "properties": {"pair": {"prefixItems": [{"maximum": 10}]}}}, [("n > 10", "maximum")]),
    "contains": (_of("pair", {"contains": {"minimum": 20}}), [("n < 20 AND k % 25 < 20", "contains"), ("n < 20 AND k % 25 < 20", "minimum")]),
    "unevaluated_items": ({"$schema": D2020, "properties": {"tags": {"prefixItems": [True, True], "unevaluatedItems": False}}}, [("t > 2", "unevaluatedItems")]),
    "min_items": (_of("tags", {"minItems": 2}), [("t < 2", "minItems")]),
    "max_items": (_of("tags", {"maxItems": 2}), [("t > 2", "maxItems")]),
    "unique_items": (_of("pair", {"uniqueItems": True}), [("n = k % 25", "uniqueItems")]),
    "min_contains": (_of("tags", {"contains": {"minimum": 2}, "minContains": 2}), [("t < 3", "contains"), ("t IN (1, 2)", "minimum")]),
    "max_contains": (_of("tags", {"contains": {"minimum": 2}, "maxContains": 2, "minContains": 0}), [("t > 3", "contains"), ("t > 3", "minimum")]),
    "enum": (_of("nation", {"enum": [1, 2, 3]}), [("n NOT IN (1, 2, 3)", "enum")]),
    "const": (_of("nation", {"const": 4}), [("n <> 4", "const")]),
    "format": (_of("date", {"format": "date"}), [("k % 2 = 0", "format")]),
    "pattern": (_of("name", {"pattern": "[05]$"}), [("right(nm, 1) NOT IN ('0', '5')", "pattern")]),
    "min_length": (_of("mixed", {"minLength": 19}), [("k % 3 = 0 AND length(nm) < 19", "minLength")]),
    "max_length": (_of("mixed", {"maxLength": 3}), [("k % 3 = 0 AND length(nm) > 3", "maxLength")]),
    "minimum": (_of("balance", {"minimum": 0}), [("b < 0", "minimum")]),
    "maximum": (_of("balance", {"maximum": 5000}), [("b > 5000", "maximum")]),
    "exclusive_minimum": (_of("key", {"exclusiveMinimum": 10}), [("k <= 10", "exclusiveMinimum")]),
    "exclusive_maximum": (_of("key", {"exclusiveMaximum": 10}), [("k >= 10", "exclusiveMaximum")]),
    "multiple_of": (_of("key", {"multipleOf": 3}), [("k % 3 <> 0", "multipleOf")]),
    "false_schema": (_of("rare", False), [("k % 8 = 0", "false schema")]),
}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = R.table(spark, sf_dir, "supplier")
    k, n = F.col("s_suppkey"), F.col("s_nationkey").cast("long")
    tags = F.when(k % 5 == 0, F.array().cast("array<long>")).otherwise(F.sequence(F.lit(1).cast("long"), (k % 5).cast("long")))
    data = {
        "key": k,
        "name": F.col("s_name"),
        "nation": n,
        "balance": F.col("s_acctbal").cast("double"),
        "tags": tags,
        "pair": F.array(n, (k % 25).cast("long")),
        "site": F.struct(n.alias("port")),
        "date": F.when(k % 2 == 0, F.lit("2024-02-30x")).otherwise("2024-02-28"),
        "extra": F.when(k % 4 == 0, F.lit("more")),
        "rare": F.when(k % 8 == 0, F.lit(1)),
    }
    # the one field that has two types: set into the text
    plain = R.json_text(**data)
    mixed = F.when(k % 3 == 0, R.quoted(F.col("s_name"))).otherwise(k.cast("string"))
    content = F.concat(F.lit(';;;\n{"mixed":'), mixed, F.lit(","), F.substr(plain, F.lit(2), F.length(plain)), F.lit("\n;;;\nText.\n"))
    return s.select(F.concat(k.cast("string"), F.lit(".md")).alias("file"), content.alias("content"))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, contract, keywords (distinct, sorted) of every document that breaks a contract."""
    names = [f"{c}.json" for c in CASES]
    registry = Registry(extra={f"{c}.json": schema for c, (schema, _) in CASES.items()})
    resolved = S.resolve(X.extract(documents(spark, sf_dir)), S.Rules(cli=tuple(names)))
    found = V.violations(resolved, registry, [(n, True) for n in names])
    return found.groupBy("file", F.regexp_replace("schema", r"\.json$", "").alias("contract")).agg(F.array_join(F.array_sort(F.collect_set("keyword")), ",").alias("keywords"))


def _sql() -> str:
    rows = "rows AS (SELECT s_suppkey AS k, s_nationkey AS n, s_acctbal::DOUBLE AS b, s_name AS nm, s_suppkey % 5 AS t FROM supplier)"
    cases = []
    for name, (_, found) in CASES.items():
        words = ", ".join(f"CASE WHEN {c} THEN '{w}' END" for c, w in sorted(found, key=lambda x: x[1]))
        cases.append(f"SELECT k || '.md' AS file, '{name}' AS contract, concat_ws(',', {words}) AS keywords FROM rows")
    return f"WITH {rows}, found AS ({' UNION ALL '.join(cases)}) SELECT * FROM found WHERE keywords <> ''"


QUERIES = {"validate_vocabulary": vocabulary}
ORACLES = {"validate_vocabulary": _sql()}
