"""Projection of metadata fields by dot path or JSON Pointer."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.functions.pointers import segments
from metaloom.functions.values import dump, load


def path_of(ref: str) -> list[str]:
    """The segments of a reference; one that starts with a slash is a pointer."""
    return segments(ref) if ref.startswith("/") else ref.split(".")


_UNSET = object()


def resolve(data: Any, ref: str) -> Any:
    """The value under a reference, or ``_UNSET``."""
    for segment in path_of(ref):
        if isinstance(data, dict) and segment in data:
            data = data[segment]
        elif isinstance(data, list) and segment.isascii() and segment.isdigit() and int(segment) < len(data):
            data = data[int(segment)]
        else:
            return _UNSET
    return data


def is_set(value: Any) -> bool:
    return value is not _UNSET


def variant_path(ref: str, arrays: bool = True) -> str:
    """The reference as a path of ``variant_get``; digits are array places with ``arrays``."""
    out = "$"
    for segment in path_of(ref):
        if arrays and segment.isascii() and segment.isdigit():
            out += f"[{int(segment)}]"
        else:
            escaped = segment.replace("\\", "\\\\").replace("'", "\\'")
            out += f"['{escaped}']"
    return out


def variant_field(variant: Column, ref: str, kind: str) -> Column:
    """A field of a VARIANT column, cast; null where it is unset, in the JVM."""
    found = F.try_variant_get(variant, variant_path(ref), kind)
    if any(s.isdigit() for s in path_of(ref)):  # digits may be a key of an object as well
        found = F.coalesce(found, F.try_variant_get(variant, variant_path(ref, arrays=False), kind))
    return found


def get(extracted: DataFrame, refs: list[str]) -> DataFrame:
    """file, present, values: a map of reference to JSON text; unset references are left out, an explicit null is "null"."""

    @F.pandas_udf("map<string,string>")
    def project(texts):
        out = []
        for text in texts:
            data = load(text)
            out.append({r: dump(v) for r in refs if is_set(v := resolve(data, r))})
        return texts.__class__(out, index=texts.index, dtype=object)

    return extracted.select("file", "present", project("data_json").alias("values"))


def format_value(value: Column) -> Column:
    """The text of a value: strings raw, others as JSON, an unset one as (unset)."""
    return F.when(value.isNull(), F.lit("(unset)")).when(value.startswith('"'), F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>")[0]).otherwise(value)


def any_set(values: Column) -> Column:
    """Whether a quiet report shows the row."""
    return F.size(values) > 0

