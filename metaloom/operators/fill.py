"""Fill: propose missing metadata, gate it, check it again and write it.

The provider is injected: ``propose(prompt, envelope) -> {key: {value, confidence, reasoning}}``.
Nothing here reaches a network; ``MockProvider`` answers from a table of values.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import subprocess
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.functions.pointers import segments
from metaloom.functions.values import canonical, dump, load
from metaloom.sources.registry import Registry

from . import writers as W
from .jsonschema import Evaluator, SchemaError, Violation

CONFIDENCE, CHUNK_CHARS, PROMPT_VERSION = 0.7, 12_000, "1"


#: Where an answer may carry the tokens it took: {"input": n, "output": n}.
USAGE = "$usage"


class ProviderError(RuntimeError):
    """A proposal that couldn't be made; ``overflow`` if the text was too long."""

    @property
    def overflow(self) -> bool:
        return re.search(r"context|too (?:long|large|many tokens)|maximum.*tokens|token limit", str(self), re.I) is not None


class Provider(Protocol):
    name: str
    model: str
    local: bool

    def propose(self, prompt: str, envelope: dict[str, Any]) -> dict[str, Any]: ...


@dataclass(frozen=True)
class MockProvider:
    """Answers from a table: key to (value, confidence)."""

    answers: dict[str, tuple[Any, float]]
    name: str = "mock"
    model: str = "table"
    local: bool = True

    def propose(self, prompt: str, envelope: dict[str, Any]) -> dict[str, Any]:
        wanted = envelope["properties"]
        return {k: {"value": v, "confidence": c, "reasoning": "a table says so"} for k, (v, c) in self.answers.items() if k in wanted}


@dataclass(frozen=True)
class CommandProvider:
    """A program that reads the prompt and the answer's schema as JSON and prints its answer as JSON."""

    command: tuple[str, ...]
    model: str = "default"
    name: str = "command"
    local: bool = True
    timeout: float = 120.0

    def propose(self, prompt: str, envelope: dict[str, Any]) -> dict[str, Any]:
        request = json.dumps({"model": self.model, "prompt": prompt, "schema": envelope})
        try:
            done = subprocess.run(self.command, input=request, capture_output=True, text=True, timeout=self.timeout, check=False)
        except (OSError, subprocess.TimeoutExpired) as e:
            raise ProviderError(f"the provider's program can't be run: {e}") from None
        if done.returncode:
            raise ProviderError(done.stderr.strip() or f"the provider's program ended with {done.returncode}")
        return _answer(done.stdout)


@dataclass(frozen=True)
class EndpointProvider:
    """An address that takes the same request by POST; local if it is this machine's."""

    url: str
    model: str = "default"
    name: str = "endpoint"
    timeout: float = 120.0
    #: (url, body, seconds) to the answer's text; a test's own, or urllib.
    post: Callable[[str, bytes, float], str] | None = None

    @property
    def local(self) -> bool:
        return (urllib.parse.urlsplit(self.url).hostname or "") in ("localhost", "127.0.0.1", "::1")

    def propose(self, prompt: str, envelope: dict[str, Any]) -> dict[str, Any]:
        body = json.dumps({"model": self.model, "prompt": prompt, "schema": envelope}).encode()
        try:
            return _answer((self.post or _post)(self.url, body, self.timeout))
        except OSError as e:
            raise ProviderError(f"the provider can't be reached: {e}") from None


def _post(url: str, body: bytes, timeout: float) -> str:
    request = urllib.request.Request(url, body, {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as got:
        return got.read().decode()


def _answer(text: str) -> dict[str, Any]:
    try:
        got = json.loads(text)
    except ValueError:
        got = None
    if not isinstance(got, dict):
        raise ProviderError("the provider's answer is no JSON object")
    return got


def pick_provider(providers: dict[str, Provider], name: str | None = None, model: str | None = None, local_only: bool = False) -> Provider:
    """The named provider, or the first for "auto"; hosted ones are refused with ``local_only``."""
    if model is not None and name in (None, "auto"):
        raise ValueError("a model needs a named provider")
    known = {n: p for n, p in providers.items() if p.local or not local_only}
    if name not in (None, "auto"):
        if name not in providers:
            raise ValueError(f"unknown provider {name!r}; there are: {', '.join(providers)}")
        if name not in known:
            raise ValueError(f"provider {name} is hosted, and only local ones are allowed")
        return known[name]
    if not known:
        raise ValueError("no provider is available")
    return next(iter(known.values()))


@dataclass(frozen=True)
class Candidate:
    """A property that a document lacks, or has with a bad value."""

    key: str
    rule: dict[str, Any]
    required: bool
    present: bool


def _described(rule: Any) -> list[str]:
    if not isinstance(rule, dict):
        return []
    own = [rule["description"]] if isinstance(rule.get("description"), str) else []
    return own or [d for part in rule.get("allOf", []) for d in _described(part)]


def merge_rules(a: dict[str, Any], b: dict[str, Any]) -> dict[str, Any]:
    """Both rules at once; equal branches and descriptions only once."""
    plain = lambda r: {k: v for k, v in r.items() if k != "description"}
    branches: dict[str, Any] = {}
    for rule in (a, b):
        parts = rule["allOf"] if set(rule) <= {"allOf", "description"} and "allOf" in rule else [rule]
        for part in parts:
            if plain(part):
                branches.setdefault(canonical(plain(part)), plain(part))
    text = " ".join(sorted(set(_described(a) + _described(b))))
    merged = next(iter(branches.values())) if len(branches) == 1 else {"allOf": list(branches.values())} if branches else {}
    return {**merged, **({"description": text} if text else {})}


def lift_definitions(schemas: list[dict[str, Any]]) -> tuple[list[dict[str, Any]], dict[str, dict[str, Any]]]:
    """The schemas with references that no longer clash, and their definitions side by side.

    A name that two schemas define differently is renamed ``name__i`` in the later one;
    definitions that are equal and refer to nothing outside of themselves are shared.
    """
    out: dict[str, dict[str, Any]] = {"$defs": {}, "definitions": {}}
    lifted = []
    for i, schema in enumerate(schemas):
        renames = {}
        for block in out:
            for name, body in schema.get(block, {}).items():
                had = out[block].get(name)
                if had is not None and not (canonical(had) == canonical(body) and '"$ref"' not in canonical(body)):
                    renames[(block, name)] = f"{name}__{i}"
        moved = _renamed(schema, renames)
        for block in out:
            for name, body in moved.get(block, {}).items():
                out[block].setdefault(renames.get((block, name), name), body)
        lifted.append(moved)
    return lifted, out


def _renamed(node: Any, renames: dict[tuple[str, str], str]) -> Any:
    if isinstance(node, list):
        return [_renamed(x, renames) for x in node]
    if not isinstance(node, dict):
        return node
    out = {k: _renamed(v, renames) for k, v in node.items()}
    if isinstance(out.get("$ref"), str) and out["$ref"].startswith("#/"):
        parts = segments(out["$ref"][1:])
        if len(parts) >= 2 and (parts[0], parts[1]) in renames:
            parts[1] = renames[(parts[0], parts[1])]
            out["$ref"] = "#/" + "/".join(p.replace("~", "~0").replace("/", "~1") for p in parts)
    return out


def candidates(schemas: list[dict[str, Any]], data: dict[str, Any], errors: list[Violation], only: set[str] | None = None) -> list[Candidate]:
    """Top-level properties that are missing or bad; optional ones only if ``only`` allows them."""
    bad = {segments(e.path)[0] for e in errors if e.path}
    rules: dict[str, dict[str, Any]] = {}
    required = set()
    for schema in schemas:
        required.update(x for x in schema.get("required", []) if isinstance(x, str))
        for key, rule in schema.get("properties", {}).items():
            if key != "$schema" and (key not in data or key in bad):
                rule = rule if isinstance(rule, dict) else {}
                rules[key] = merge_rules(rules[key], rule) if key in rules else rule
    return [Candidate(k, r, k in required, k in data) for k, r in rules.items() if only is None or k in only or k in required]


def envelope(wanted: list[Candidate], definitions: dict[str, dict[str, Any]]) -> dict[str, Any]:
    """The contract of an answer: for each key a value, a confidence and a reason."""

    def one(c: Candidate) -> dict[str, Any]:
        return {
            "type": "object",
            "additionalProperties": False,
            "required": ["value", "confidence", "reasoning"],
            "properties": {"value": c.rule, "confidence": {"type": "number", "minimum": 0, "maximum": 1}, "reasoning": {"type": "string"}},
        }

    return {"type": "object", "additionalProperties": False, **{k: v for k, v in definitions.items() if v}, "properties": {c.key: one(c) for c in wanted}}


def split_body(body: str, most: int = CHUNK_CHARS) -> list[str]:
    """Pieces of at most ``most`` characters, cut behind a line break where one fits; joined, they are the body."""
    out, at = [], 0
    while len(body) - at > most:
        newline = body.rfind("\n", at, at + most)
        to = newline + 1 if newline > at else at + most
        out.append(body[at:to])
        at = to
    return [*out, body[at:]]


def prompt(file: str, data: dict[str, Any], wanted: list[Candidate], body: str, part: tuple[int, int] = (0, 1)) -> str:
    lines = [f"File: {file}", f"Metadata it has: {dump(data)}", "Properties to propose:"]
    lines += [f"- {c.key}{' (required)' if c.required else ''}{': ' + ' '.join(_described(c.rule)) if _described(c.rule) else ''}" for c in wanted]
    if part[1] > 1:
        lines.append(f"This is part {part[0] + 1} of {part[1]} of the text.")
    return "\n".join([*lines, "", body])


def merge_proposals(sets: list[dict[str, Any]]) -> dict[str, Any]:
    """The most confident proposal of each key; the earlier part's on a tie."""
    out: dict[str, Any] = {}
    for proposals in sets:
        for key, p in proposals.items():
            if key not in out or p["confidence"] > out[key]["confidence"]:
                out[key] = p
    return out


def cache_key(provider: Provider, chunk_chars: int, refs: list[str], wanted: list[Candidate], content: str) -> str:
    """What a proposal depends on, as a digest."""
    parts = [provider.name, provider.model, PROMPT_VERSION, str(chunk_chars), *refs, "|", *sorted(c.key for c in wanted), "|", hashlib.sha256(content.encode("utf-8", "surrogatepass")).hexdigest()]
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()


def gate(wanted: list[Candidate], proposals: dict[str, Any], threshold: float = CONFIDENCE) -> list[dict[str, Any]]:
    """The field of each candidate: accepted, or why not."""
    out = []
    for c in wanted:
        p = proposals.get(c.key)
        reason = "no-proposal" if p is None else None if p["confidence"] >= threshold else "low-confidence"
        one = {"key": c.key, "required": c.required, "confidence": p["confidence"] if p else 0.0, "reasoning": p["reasoning"] if p else "", "reason": reason}
        out.append({**one, "value": p["value"]} if p else one)
    return out


@dataclass
class Options:
    threshold: float = CONFIDENCE
    chunk_chars: int = CHUNK_CHARS
    only: frozenset[str] | None = None
    #: Calls that the run may make; None for no bound.
    max_turns: int | None = None
    #: Documents that are asked about at the same time; None for as many as there are partitions.
    concurrency: int | None = None
    #: Price of a million tokens read and written.
    prices: tuple[float, float] | None = None
    cached: dict[str, dict[str, Any]] = field(default_factory=dict)


@dataclass
class Filled:
    fields: list[dict[str, Any]]
    content: str
    changed: bool
    error: str | None = None
    calls: int = 0
    tokens: tuple[int, int] = (0, 0)
    from_cache: bool = False
    key: str | None = None
    proposals: dict[str, Any] = field(default_factory=dict)


def _ask(provider: Provider, file: str, data: dict, wanted: list[Candidate], content: str, answer: dict, options: Options, spend, used) -> dict[str, Any]:
    # the shape of the answer; values that break their rule are taken back one by one later
    check = Evaluator(envelope([Candidate(c.key, {}, c.required, c.present) for c in wanted], {}))

    def ask(parts: list[str]) -> list[dict[str, Any]]:
        out = []
        for i, part in enumerate(parts):
            spend()
            got = provider.propose(prompt(file, data, wanted, part, (i, len(parts))), answer)
            got = dict(got)
            used(got.pop(USAGE, None))
            if found := check.evaluate(got):
                raise ProviderError(f"the answer breaks its contract: {found[0].path} {found[0].message}")
            out.append(got)
        return out

    try:
        return merge_proposals(ask(split_body(content, options.chunk_chars)))
    except ProviderError as e:
        if not e.overflow:
            raise
        return merge_proposals(ask(split_body(content, max(1, options.chunk_chars // 2))))


def fill_one(file: str, name: str, content: str, data: dict[str, Any], refs: list[str], evaluators: dict[str, Evaluator], provider: Provider, options: Options, spend=lambda: None) -> Filled:
    """Propose, gate, check and write one document."""
    nothing = Filled([], content, False)
    if name not in W.WRITERS:
        return Filled([], content, False, f"format {name} can't be written")
    bare = {k: v for k, v in data.items() if k != "$schema"}
    errors = [v for r in refs for v in evaluators[r].evaluate(bare)]
    schemas, definitions = lift_definitions([evaluators[r].root for r in refs if isinstance(evaluators[r].root, dict)])
    wanted = candidates(schemas, data, errors, options.only)
    if not wanted:
        return nothing
    if why := W.can_write(name, content, file):
        return Filled([], content, False, why)
    key = cache_key(provider, options.chunk_chars, refs, wanted, content)
    calls, tokens = 0, [0, 0]

    def count() -> None:
        nonlocal calls
        spend()
        calls += 1

    def used(usage: Any) -> None:
        for i, k in enumerate(("input", "output")):
            n = usage.get(k) if isinstance(usage, dict) else None
            tokens[i] += n if isinstance(n, int) and not isinstance(n, bool) and n > 0 else 0

    proposals = options.cached.get(key)
    from_cache = proposals is not None
    if proposals is None:
        try:
            proposals = _ask(provider, file, data, wanted, content, envelope(wanted, definitions), options, count, used)
        except (ProviderError, SchemaError) as e:
            return Filled([], content, False, str(e), calls, tuple(tokens))
    fields = gate(wanted, proposals, options.threshold)
    patch = {f["key"]: f["value"] for f in fields if f["reason"] is None}
    # what would still break its contract is taken back
    after = [v for r in refs for v in evaluators[r].evaluate({**bare, **patch})]
    broken = {segments(v.path)[0] for v in after if v.path}
    for f in fields:
        if f["reason"] is None and f["key"] in broken:
            f["reason"] = "schema-mismatch"
            patch.pop(f["key"])
    out = Filled(fields, content, False, None, calls, tuple(tokens), from_cache, key, proposals)
    if patch:
        try:
            out.content = W.apply(name, content, patch, file)
            out.changed = out.content != content
        except W.WriteError as e:
            out.error = str(e)
    return out


FIELD = "struct<key:string,required:boolean,confidence:double,reasoning:string,value:string,reason:string>"


def fill(resolved: DataFrame, registry: Registry, provider: Provider, refs: list[str], options: Options | None = None) -> DataFrame:
    """file, format, fields, content, changed, error, calls, tokens, cached, cache_key, proposals of every document.

    ``resolved`` has content beside the columns of ``resolve``.  ``concurrency`` is the
    number of partitions.  Executors share no counter, so each partition has its share of
    ``max_turns``; the run never makes more calls.  Documents beyond it get an error,
    none is lost.
    """
    options = options or Options()
    if options.concurrency is not None:
        resolved = resolved.repartition(options.concurrency)
    elif options.max_turns is not None:
        resolved = resolved.repartition(max(1, min(options.max_turns, resolved.sparkSession.sparkContext.defaultParallelism)))
    partitions = options.concurrency or max(1, min(options.max_turns or 1, resolved.sparkSession.sparkContext.defaultParallelism))
    evaluators = {r: registry.compile(r) for r in refs}
    kinds = {"format": pa.string(), "content": pa.string(), "changed": pa.bool_(), "error": pa.string(), "calls": pa.int32(), "input_tokens": pa.int64(), "output_tokens": pa.int64(), "cached": pa.bool_(), "cache_key": pa.string(), "proposals": pa.string()}
    item = pa.struct([("key", pa.string()), ("required", pa.bool_()), ("confidence", pa.float64()), ("reasoning", pa.string()), ("value", pa.string()), ("reason", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = options.max_turns
        if left is not None:
            own = TaskContext.get().partitionId()
            left = left // partitions + (own < left % partitions)

        def spend() -> None:
            nonlocal left
            if left is not None:
                if left <= 0:
                    raise ProviderError("the bound on calls is reached")
                left -= 1

        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                problem = row["error"] or row["schema_error"]
                if problem is None:
                    unknown = [r for r in row["schemas"] if r not in evaluators]
                    problem = f"schema {unknown[0]} isn't loaded" if unknown else None
                if problem is not None:
                    done = Filled([], row["content"], False, problem)
                else:
                    done = fill_one(row["file"], row["format"], row["content"], load(row["data_json"]), row["schemas"], evaluators, provider, options, spend)
                rows.append((row["file"], row["format"], done))
            fields = [[{**{k: f[k] for k in ("key", "required", "confidence", "reasoning", "reason")}, "value": dump(f["value"]) if "value" in f else None} for f in d.fields] for _, _, d in rows]
            columns = {
                "format": [n for _, n, _ in rows],
                "content": [d.content for *_, d in rows],
                "changed": [d.changed for *_, d in rows],
                "error": [d.error for *_, d in rows],
                "calls": [d.calls for *_, d in rows],
                "input_tokens": [d.tokens[0] for *_, d in rows],
                "output_tokens": [d.tokens[1] for *_, d in rows],
                "cached": [d.from_cache for *_, d in rows],
                "cache_key": [d.key for *_, d in rows],
                "proposals": [json.dumps(d.proposals) for *_, d in rows],
            }
            arrays = [pa.array([f for f, *_ in rows], pa.string()), pa.array(fields, pa.list_(item)), *[pa.array(v, kinds[k]) for k, v in columns.items()]]
            yield pa.RecordBatch.from_arrays(arrays, ["file", "fields", *columns])

    schema = f"file string, fields array<{FIELD}>, format string, content string, changed boolean, error string, calls int, input_tokens long, output_tokens long, cached boolean, cache_key string, proposals string"
    return resolved.select("file", "format", "content", "data_json", "schemas", "error", "schema_error").mapInArrow(run, schema)


def read_cache(path: str) -> dict[str, dict[str, Any]]:
    """Stored proposals by key; a line that can't be read is left out."""
    out: dict[str, dict[str, Any]] = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as lines:
            for line in lines:
                try:
                    row = json.loads(line)
                    out[row["key"]] = row["proposals"]
                except (ValueError, KeyError, TypeError):
                    continue
    return out


def store_cache(path: str, filled: DataFrame) -> int:
    """Adds the proposals that this run asked for; returns how many."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    n = 0
    fresh = filled.where("NOT cached AND cache_key IS NOT NULL AND proposals <> '{}'").select("cache_key", "proposals").dropDuplicates(["cache_key"])
    with open(path, "a", encoding="utf-8") as out:
        for row in fresh.orderBy("cache_key").toLocalIterator():
            out.write(f'{{"key": {json.dumps(row["cache_key"])}, "proposals": {row["proposals"]}}}\n')
            n += 1
    return n


def summary(filled: DataFrame, prices: tuple[float, float] | None = None) -> DataFrame:
    """files, changed, written, skipped, required_skipped, errors, calls, tokens, cost and cached of a run; no prices, no cost."""
    read, wrote = (F.coalesce(F.sum(f"{k}_tokens"), F.lit(0)) for k in ("input", "output"))
    cost = F.lit(None).cast("double") if prices is None else (read * F.lit(prices[0]) + wrote * F.lit(prices[1])) / F.lit(1e6)
    written = F.size(F.filter("fields", lambda f: f["reason"].isNull()))
    skipped = F.filter("fields", lambda f: f["reason"].isNotNull())
    return filled.agg(
        F.count("*").alias("files"),
        F.count_if("changed").alias("changed"),
        F.coalesce(F.sum(written), F.lit(0)).alias("written"),
        F.coalesce(F.sum(F.size(skipped)), F.lit(0)).alias("skipped"),
        F.coalesce(F.sum(F.size(F.filter(skipped, lambda f: f["required"]))), F.lit(0)).alias("required_skipped"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"),
        read.alias("input_tokens"),
        wrote.alias("output_tokens"),
        cost.alias("cost"),
        F.count_if("cached").alias("cached"),
    )


def github_rows(filled: DataFrame) -> DataFrame:
    """file, line: annotations of required fields left unfilled, and of documents with errors."""
    from metaloom.functions.text import command_message, command_property

    unfilled = filled.select("file", F.explode(F.filter("fields", lambda f: f["required"] & f["reason"].isNotNull())).alias("f"))
    left = unfilled.select("file", F.concat(F.lit("/"), F.col("f.key"), F.lit(" required field not filled: "), F.col("f.reason")).alias("text"))
    both = left.union(filled.where("error IS NOT NULL").select("file", F.col("error").alias("text")))
    return both.select("file", F.concat(F.lit("::error file="), command_property(F.col("file")), F.lit("::"), command_message(F.col("text"))).alias("line"))


def pretty_rows(filled: DataFrame) -> DataFrame:
    """file, line: what happened to each candidate of a document; documents without any only if they failed."""

    def one(f):
        value = F.coalesce(f["value"], F.lit("-"))
        outcome = F.coalesce(F.concat(F.lit("skipped: "), f["reason"]), F.lit("written"))
        return F.concat(F.lit("\n    /"), f["key"], F.lit("  "), value, F.lit("  "), F.format_string("%.2f", f["confidence"]), F.lit("  "), outcome)

    mark = F.when(F.col("error").isNotNull(), "✗").when(F.col("changed"), "✎").otherwise("·")
    problem = F.coalesce(F.concat(F.lit("  "), F.col("error")), F.lit(""))
    rows = filled.where((F.size("fields") > 0) | F.col("error").isNotNull())
    return rows.select("file", F.concat(mark, F.lit(" "), F.col("file"), problem, F.array_join(F.transform("fields", one), "")).alias("line"))


def json_rows(filled: DataFrame) -> DataFrame:
    """file, line: each document's fields as a JSON object."""
    return filled.select("file", F.to_json(F.struct("file", "format", "fields", "changed", "error")).alias("line"))


def exit_code(counts: dict[str, int]) -> int:
    return 1 if counts["required_skipped"] or counts["errors"] else 0
