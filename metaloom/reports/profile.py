"""The text report of an inference run, and of projected fields."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.operators.fields import any_set, format_value

from .render import paint

OUTLIERS_SHOWN, ENUM_SHOWN, SAMPLE_WIDTH = 5, 3, 46


def _shown(value: str) -> str:
    parsed = json.loads(value)
    return parsed if isinstance(parsed, str) else value


def sample_cell(row: dict) -> str:
    if row["enum"]:
        text = " | ".join([*map(_shown, row["enum"][:ENUM_SHOWN]), *(["…"] if len(row["enum"]) > ENUM_SHOWN else [])])
    else:
        text = row["sample"] or ""
    return text if len(text) <= SAMPLE_WIDTH else text[: SAMPLE_WIDTH - 1] + "…"


def types_cell(row: dict) -> str:
    if len(row["types"]) > 1:
        return ", ".join(f"{t['type']} ×{t['n']:,}" for t in row["types"])
    note = f"{len(row['enum'])} enum" if row["enum"] else row["format"]
    return f"{row['type']} ({note})" if note else row["type"]


def infer_table(keys: list[dict], outliers: list[dict], scanned: int, bare: int, unreadable: list[tuple[str, str]], hidden: int = 0, color: bool = False) -> Iterator[str]:
    """Lines of the report; ``keys`` are profile rows in report order, ``outliers`` at most 20 a key and type."""
    head = [f"{scanned:,} file{'' if scanned == 1 else 's'} scanned", f"{bare:,} with no metadata block", *([f"{len(unreadable):,} unreadable"] if unreadable else [])]
    yield paint(" · ", "dim", color).join(head)
    if not keys:
        yield from ("", paint("No metadata keys found.", "dim", color))
        return
    rows = [(k["key"], f"{k['coverage']:.1f}%", types_cell(k), sample_cell(k)) for k in keys]
    wide = [max(len(h), *(len(r[i]) for r in rows)) for i, h in enumerate(("key", "coverage", "types"))]
    yield ""
    yield paint(f"{'key':<{wide[0]}}  {'coverage':>{wide[1]}}  {'types':<{wide[2]}}  sample", "dim", color)
    for key, coverage, types, sample in rows:
        yield f"{paint(f'{key:<{wide[0]}}', 'cyan', color)}  {coverage:>{wide[1]}}  {types:<{wide[2]}}  {paint(sample, 'dim', color)}"
    if hidden:
        yield from ("", paint(f"{hidden:,} key(s) below --min-coverage are not shown.", "dim", color))
    odd: dict[str, list[dict]] = {}
    for o in outliers:
        odd.setdefault(o["key"], []).append(o)
    if odd:
        yield from ("", paint("Type outliers — these are data errors, not a union:", "bold", color))
    for k in keys:
        found = odd.get(k["key"], [])
        for o in found[:OUTLIERS_SHOWN]:
            yield f"  {k['key']}  {o['file']}  {o['type']} (expected {k['type']})"
        rest = sum(t["n"] for t in k["types"] if t["type"] != k["type"]) - min(len(found), OUTLIERS_SHOWN)
        if found and rest > 0:
            yield paint(f"  {k['key']}  …and {rest:,} more", "dim", color)
    for file, why in unreadable:
        yield from ("", f"{paint('!', 'yellow', color)} {file}: {why}")


def get_rows(got: DataFrame, refs: list[str], quiet: bool = False) -> DataFrame:
    """file, line: the file and below it a line for each reference; ``quiet`` hides files where none is set."""
    rows = got.where(any_set(F.col("values"))) if quiet else got
    each = [F.concat(F.lit(f"\n  {r}: "), format_value(F.try_element_at("values", F.lit(r)))) for r in refs]
    return rows.select("file", F.concat("file", *each).alias("line"))


def get_json_rows(got: DataFrame, refs: list[str]) -> DataFrame:
    """file, line: JSON objects with the set references only; an explicit null stays."""
    pairs = F.filter(F.array(*[F.struct(F.lit(json.dumps(r)).alias("k"), F.try_element_at("values", F.lit(r)).alias("v")) for r in refs]), lambda p: p["v"].isNotNull())
    fields = F.array_join(F.transform(pairs, lambda p: F.concat(p["k"], F.lit(":"), p["v"])), ",")
    name = F.to_json(F.struct("file", "present"))
    return got.select("file", F.concat(F.substr(name, F.lit(1), F.length(name) - 1), F.lit(',"fields":{'), fields, F.lit("}}")).alias("line"))
