"""Reports of a validation run: pretty, json, github, sarif, junit.

Everything that grows with the documents is formatted in the plan, as one text row a
document or violation (``*_rows``), and can be written as it is; the ``render``
functions stream those rows in order of file and put head and foot around them.
"""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom import __version__
from metaloom.functions.text import command_message, command_property, field_label, rule_id, xml_text
from metaloom.operators.baseline import fingerprint

FORMATS = ("pretty", "json", "github", "sarif", "junit")
COLORS = {"red": 31, "green": 32, "yellow": 33, "cyan": 36, "dim": 2, "bold": 1}


def use_color(asked: bool | None = None) -> bool:
    """Off if asked so, if NO_COLOR is set, or where no terminal reads."""
    if asked is False or os.environ.get("NO_COLOR"):
        return False
    return bool(asked) or sys.stdout.isatty()


def paint(text: str, color: str, on: bool) -> str:
    return f"\x1b[{COLORS[color]}m{text}\x1b[0m" if on else text


def any_of(names: tuple[str, ...]) -> str:
    """"a", "a or b", "a, b, or c"."""
    if len(names) < 3:
        return " or ".join(names)
    return ", ".join(names[:-1]) + f", or {names[-1]}"


def _ordered(rows: DataFrame) -> Iterator[str]:
    """The lines of (file, ord, line) rows, a partition at a time."""
    keys = [c for c in ("file", "ord") if c in rows.columns]
    return (r["line"] for r in rows.where("line IS NOT NULL").orderBy(*keys).toLocalIterator(prefetchPartitions=True))


def _each(results: DataFrame) -> DataFrame:
    return results.select("file", F.explode("errors").alias("e")).select("file", "e.*")


def _color(column, name: str, on: bool):
    return F.concat(F.lit(f"\x1b[{COLORS[name]}m"), column, F.lit("\x1b[0m")) if on else column


def pretty_rows(results: DataFrame, quiet: bool = False, color: bool = False) -> DataFrame:
    """file, line: a mark and the file, and below it its violations; passing files only without ``quiet``."""
    forgiven = F.lit("")
    if "baselined" in results.columns:
        forgiven = F.when(F.col("baselined") > 0, _color(F.format_string("  (%d baselined)", "baselined"), "dim", color)).otherwise("")

    def violation(e):
        at = F.when(e["line"].isNotNull(), _color(F.format_string("  (line %d)", e["line"]), "dim", color)).otherwise("")
        return F.concat(F.lit("\n    "), _color(field_label(e["instance_path"]), "cyan", color), F.lit("  "), e["message"], at, F.lit("  "), _color(F.concat(F.lit("["), e["schema"], F.lit("]")), "dim", color))

    passed = F.lit(None).cast("string") if quiet else F.concat(_color(F.lit("✓"), "green", color), F.lit(" "), F.col("file"), forgiven)
    failed = F.concat(_color(F.lit("✗"), "red", color), F.lit(" "), F.col("file"), forgiven, F.array_join(F.transform("errors", violation), ""))
    return results.select("file", F.when(F.col("ok"), passed).otherwise(failed).alias("line"))


def _plural(n: int, one: str, many: str) -> str:
    return f"{n} {one if n == 1 else many}"


def summary_line(summary: dict) -> str:
    skipped = f", {summary['gitignore_skipped']} skipped by .gitignore" if summary.get("gitignore_skipped") else ""
    return f"{_plural(summary['files'], 'file', 'files')} checked, {summary['passed']} passed, {summary['failed']} failed, {_plural(summary['errors'], 'error', 'errors')}{skipped}"


def baseline_lines(b: dict) -> list[str]:
    if b.get("written"):
        gone = "no longer occurs" if b["removed"] == 1 else "no longer occur"
        return [f"Baseline written to {b['path']}", f"  {_plural(b['recorded'], 'finding', 'findings')} recorded (+{b['added']} new, -{b['removed']} {gone})"]
    head = _plural(b["recorded"], "baselined finding", "baselined findings")
    if not b["stale"]:
        return [head]
    return [f"{head}, {b['stale']} no longer {'occurs' if b['stale'] == 1 else 'occur'} — run --write-baseline to prune"]


def pretty(results: DataFrame, summary: dict, quiet: bool = False, color: bool = False) -> Iterator[str]:
    some = False
    for line in _ordered(pretty_rows(results, quiet, color)):
        some = True
        yield line
    if some:
        yield ""
    yield paint(summary_line(summary), "red" if summary["failed"] else "green", color)
    for line in baseline_lines(summary["baseline"]) if summary.get("baseline") else ():
        yield paint(line, "dim", color)


def json_rows(results: DataFrame) -> DataFrame:
    """file, line: each result as a JSON object; unset members are left out."""
    names = {"instance_path": "instancePath"}

    def error(e):
        return F.struct(*[e[k].alias(names.get(k, k)) for k in ("schema", "instance_path", "message", "keyword", "subject", "line", "col")])

    more = [F.col("baselined")] if "baselined" in results.columns else []
    return results.select("file", F.to_json(F.struct("file", "format", "ok", "schemas", F.transform("errors", error).alias("errors"), *more)).alias("line"))


def as_json(results: DataFrame, summary: dict) -> Iterator[str]:
    yield '{"summary": ' + json.dumps(summary) + ', "results": ['
    before = None
    for line in _ordered(json_rows(results)):
        if before is not None:
            yield before + ","
        before = line
    if before is not None:
        yield before
    yield "]}"


def github_rows(results: DataFrame) -> DataFrame:
    """file, ord, line: a workflow command for each violation."""
    at = F.concat(
        F.lit("file="),
        command_property(F.col("file")),
        F.when(F.col("line").isNotNull(), F.concat(F.lit(",line="), F.col("line").cast("string"))).otherwise(""),
        F.when(F.col("col").isNotNull(), F.concat(F.lit(",col="), F.col("col").cast("string"))).otherwise(""),
    )
    text = F.concat(F.lit("["), F.col("schema"), F.lit("] "), field_label(F.col("instance_path")), F.lit(" "), F.col("message"))
    return _each(results).select("file", "ord", F.concat(F.lit("::error "), at, F.lit("::"), command_message(text)).alias("line"))


def sarif_rows(results: DataFrame) -> DataFrame:
    """file, ord, rule, line: SARIF result objects; standard input and files outside of the root have none."""
    inside = (F.col("file") != "<stdin>") & ~F.col("file").startswith("../") & ~F.col("file").startswith("/") & (F.col("file") != "")
    rule = rule_id(F.col("schema"), F.col("keyword"))
    region = F.when(F.col("line").isNotNull(), F.struct(F.col("line").alias("startLine")))
    location = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    body = F.struct(
        rule.alias("ruleId"),
        F.lit("error").alias("level"),
        F.struct(F.concat_ws(" ", field_label(F.col("instance_path")), "message").alias("text")).alias("message"),
        F.array(location).alias("locations"),
        F.struct(fingerprint(F.col("schema"), F.col("instance_path"), F.col("keyword"), F.col("subject")).alias("metaloom/v1")).alias("partialFingerprints"),
    )
    return _each(results).where(inside).select("file", "ord", rule.alias("rule"), F.to_json(body).alias("line"))


def sarif(results: DataFrame) -> Iterator[str]:
    rows = sarif_rows(results)
    # a row a rule: as many as the contracts have keywords
    rules = [r["rule"] for r in rows.select("rule").distinct().orderBy("rule").collect()]
    driver = {"name": "metaloom", "version": __version__, "rules": [{"id": r, "shortDescription": {"text": f"Metadata rule {r}"}} for r in rules]}
    yield '{"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": ' + json.dumps({"driver": driver}) + ', "results": ['
    before = None
    for line in _ordered(rows):
        if before is not None:
            yield before + ","
        before = line
    if before is not None:
        yield before
    yield "]}]}"


def junit_rows(results: DataFrame) -> DataFrame:
    """file, line: a test case for each document, a failure in it for each violation."""

    def failure(e):
        at = F.when(e["line"].isNotNull(), F.format_string(" (line %d)", e["line"])).otherwise("")
        message = xml_text(F.concat(field_label(e["instance_path"]), F.lit(" "), e["message"], at))
        return F.concat(F.lit('\n      <failure type="'), xml_text(rule_id(e["schema"], e["keyword"])), F.lit('" message="'), message, F.lit('"/>'))

    head = F.concat(F.lit('    <testcase name="'), xml_text(F.col("file")), F.lit('" classname="metaloom"'))
    body = F.concat(head, F.lit(">"), F.array_join(F.transform("errors", failure), ""), F.lit("\n    </testcase>"))
    return results.select("file", F.when(F.size("errors") == 0, F.concat(head, F.lit("/>"))).otherwise(body).alias("line"))


def junit(results: DataFrame, summary: dict) -> Iterator[str]:
    counts = f'name="metaloom" tests="{summary["files"]}" failures="{summary["failed"]}" errors="0"'
    yield '<?xml version="1.0" encoding="UTF-8"?>'
    yield f"<testsuites {counts}>"
    yield f"  <testsuite {counts}>"
    yield from _ordered(junit_rows(results))
    yield "  </testsuite>"
    yield "</testsuites>"


def render(form: str, results: DataFrame, summary: dict, quiet: bool = False, color: bool = False) -> Iterator[str]:
    """The report's lines."""
    if form == "pretty":
        return pretty(results, summary, quiet, color)
    if form == "json":
        return as_json(results, summary)
    if form == "github":
        return _ordered(github_rows(results))
    if form == "sarif":
        return sarif(results)
    if form == "junit":
        return junit(results, summary)
    raise ValueError(f"unknown report format {form!r}; use {any_of(FORMATS)}")


def exit_code(summary: dict) -> int:
    return 1 if summary["failed"] else 0
