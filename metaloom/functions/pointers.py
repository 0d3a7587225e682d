"""JSON Pointers and the positions kept under them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Positions = dict[str, tuple[int, int | None]]


def escape(segment: str) -> str:
    return segment.replace("~", "~0").replace("/", "~1")


def unescape(segment: str) -> str:
    return segment.replace("~1", "/").replace("~0", "~")


def segments(pointer: str) -> list[str]:
    return [unescape(s) for s in pointer.split("/")[1:]]


def escape_column(segment: Column) -> Column:
    return F.replace(F.replace(segment, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def top_key(pointer: Column) -> Column:
    """The first segment of a pointer, unescaped; null for the root."""
    part = F.replace(F.replace(F.split_part(pointer, F.lit("/"), F.lit(2)), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
    return F.when(pointer != "", part)


def ancestors(pointer: str) -> list[str]:
    """The pointer and those above it, the nearest first, the root last."""
    out = []
    while pointer:
        out.append(pointer)
        pointer = pointer[: pointer.rindex("/")]
    return [*out, ""]


def look_up(places: dict[str, int], pointer: str) -> int | None:
    """The position kept under a pointer (or a bare key) or under its nearest ancestor."""
    if pointer and not pointer.startswith("/"):
        pointer = f"/{escape(pointer)}"
    return next((places[p] for p in ancestors(pointer) if p in places), None)


def look_up_column(places: Column, pointer: Column) -> Column:
    """``look_up`` over a map column of positions."""
    depth = F.size(F.split(pointer, "/"))
    tries = F.transform(F.sequence(depth, F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(F.split(pointer, "/"), F.lit(1), n), "/"))
    return F.try_element_at(F.filter(F.transform(tries, lambda p: F.try_element_at(places, p)), lambda x: x.isNotNull()), F.lit(1))
