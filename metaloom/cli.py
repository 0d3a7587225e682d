"""The command line: validate, get, fill, schemas."""

from __future__ import annotations

import argparse
import difflib
import json
import os
import shlex
import sys
from typing import Any

from metaloom import __version__
from metaloom.operators.jsonschema import SchemaError

COMMANDS = ("validate", "get", "fill", "schemas")


def split_list(text: str) -> list[str]:
    return [x for x in map(str.strip, text.split(",")) if x]


def suggest(word: str) -> str | None:
    """The command that a mistyped word is nearest to; none for a path that is there."""
    if word in COMMANDS or word.startswith("-") or os.path.exists(word):
        return None
    near = difflib.get_close_matches(word, COMMANDS, 1, 0.6)
    return near[0] if near else None


def looks_like_path(token: str, cwd: str = ".") -> bool:
    """Whether a word names a file rather than a field: it is there, is a glob, or has a separator and no leading slash."""
    if os.path.exists(os.path.join(cwd, token)) or any(c in token for c in "*?[{"):
        return True
    return ("/" in token and not token.startswith("/")) or token == "-"


def get_inputs(first: str | None, paths: list[str], fields: str | None, cwd: str = ".") -> tuple[list[str], list[str]]:
    """(fields, paths) of ``get``: with a fields option all words are paths; otherwise the first is the fields."""
    if fields is not None:
        return split_list(fields), [*([first] if first else []), *paths]
    if first is None or (not paths and looks_like_path(first, cwd)):
        raise ValueError("get needs fields: give them first, or by --fields")
    return split_list(first), paths


def _common(p: argparse.ArgumentParser) -> None:
    p.add_argument("--ext", type=split_list, default=None)
    p.add_argument("--as", dest="as_format", default=None)
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("-c", "--config", default=None)
    p.add_argument("--no-config", dest="config", action="store_false")
    p.add_argument("--gitignore", action=argparse.BooleanOptionalAction, default=None)
    p.add_argument("--allow-empty", action="store_true", default=None)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("metaloom", description="Check, read, profile and fill document metadata.")
    top.add_argument("--version", action="version", version=__version__)
    top.add_argument("--no-color", dest="color", action="store_false", default=None)
    verbs = top.add_subparsers(dest="verb", required=True)
    v = verbs.add_parser("validate")
    v.add_argument("paths", nargs="*")
    v.add_argument("-s", "--schema", action="append", default=[])
    v.add_argument("-f", "--format", default="pretty", choices=("pretty", "json", "github", "sarif", "junit"))
    v.add_argument("-q", "--quiet", action="store_true")
    v.add_argument("--offline", action="store_true", default=None)
    v.add_argument("--baseline", nargs="?", const=True, default=None)
    v.add_argument("--no-baseline", dest="baseline", action="store_false")
    v.add_argument("--write-baseline", nargs="?", const=True, default=False, metavar="path")
    g = verbs.add_parser("get")
    g.add_argument("first", nargs="?", metavar="fields")
    g.add_argument("paths", nargs="*")
    g.add_argument("--fields", default=None)
    g.add_argument("-f", "--format", default="pretty", choices=("pretty", "json"))
    g.add_argument("-q", "--quiet", action="store_true")
    f = verbs.add_parser("fill")
    f.add_argument("paths", nargs="*")
    f.add_argument("-s", "--schema", action="append", default=[])
    f.add_argument("--answers", default=None, help="JSON file of key to [value, confidence], the table provider")
    f.add_argument("--command", default=None, help="program that reads a request and prints an answer as JSON, the command provider")
    f.add_argument("--endpoint", default=None, help="address that takes the same request, the endpoint provider")
    f.add_argument("--provider", default=None, help="table, command, endpoint or auto")
    f.add_argument("--model", default=None)
    f.add_argument("--local", action="store_true", help="local providers only")
    f.add_argument("--fields", default=None)
    f.add_argument("--max-turns", type=int, default=None)
    f.add_argument("--chunk-chars", type=int, default=None)
    f.add_argument("--concurrency", type=int, default=None)
    f.add_argument("--no-cache", dest="cache", action="store_false", default=True)
    f.add_argument("--offline", action="store_true", default=None)
    f.add_argument("--confidence", type=float, default=None)
    f.add_argument("--dry-run", action="store_true")
    f.add_argument("-f", "--format", default="pretty", choices=("pretty", "json", "github"))
    s = verbs.add_parser("schemas")
    s.add_argument("action", nargs="?", default="list", choices=("list", "infer", "vendor"))
    s.add_argument("paths", nargs="*")
    s.add_argument("--min-coverage", type=float, default=0.0)
    s.add_argument("--out", default=None)
    s.add_argument("--folder", "--dir", default="schemas")
    s.add_argument("-f", "--format", default="pretty", choices=("pretty", "json"))
    for p in (v, g, f, s):
        _common(p)
    return top


def _baseline(args: argparse.Namespace, configured: str | bool | None) -> tuple[Any, bool]:
    """(path, whether to write it): a flag without a path means the configured file, or the usual one."""
    usual = configured if isinstance(configured, str) else BASELINE
    if args.write_baseline:
        path = args.write_baseline if isinstance(args.write_baseline, str) else args.baseline
        return (path if isinstance(path, str) else usual), True
    return (usual if args.baseline is True else args.baseline), False


#: The usual baseline file.
BASELINE = ".metaloom-baseline.json"


def _providers(args: argparse.Namespace, model: str | None, cwd: str) -> dict[str, Any]:
    """The providers that the command line describes, in the order in which "auto" takes them."""
    from metaloom.operators import fill as FI

    found: dict[str, Any] = {}
    if args.answers is not None:
        with open(os.path.join(cwd, args.answers), encoding="utf-8") as f:
            found["table"] = FI.MockProvider({k: tuple(v) for k, v in json.load(f).items()})
    if args.command is not None:
        found["command"] = FI.CommandProvider(tuple(shlex.split(args.command)), model or "default")
    if args.endpoint is not None:
        found["endpoint"] = FI.EndpointProvider(args.endpoint, model or "default")
    return found


def main(argv: list[str] | None = None, spark=None, cwd: str = ".", out=None) -> int:
    """Runs a command; 0 for success, 1 for findings, 2 for a failure of the run itself."""
    argv = sys.argv[1:] if argv is None else argv
    say = lambda line: print(line, file=out or sys.stdout)
    if argv and (near := suggest(argv[0])):
        print(f"unknown command {argv[0]}; did you mean {near}?", file=sys.stderr)
        return 2
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0) and 2
    try:
        return _run(args, spark, cwd, say)
    except (ValueError, OSError, SchemaError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


def _run(args: argparse.Namespace, spark, cwd: str, say) -> int:
    from metaloom import api
    from metaloom.operators import fill as FI
    from metaloom.reports.render import use_color
    from metaloom.sources import registry, sinks, vendor

    if args.verb == "schemas" and args.action == "list":
        rows = registry.catalog()
        say(json.dumps([{"id": i, "title": t} for i, t in rows], indent=2) if args.format == "json" else "\n".join(f"{i}  {t}" for i, t in rows))
        return 0
    if args.verb == "schemas" and args.action == "vendor":
        path, entries = vendor.vendor(args.paths[0], registry.Registry(cwd), args.folder, cwd)
        say(f"{path}\n{json.dumps(entries, indent=2)}")
        return 0
    if args.verb == "schemas" and args.out:
        sinks.refuse_target(args.out, cwd)  # before anything is scanned
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("metaloom").getOrCreate()
    refs: list[str] = []
    if args.verb == "get":
        refs, args.paths = get_inputs(args.first, args.paths, args.fields, cwd)
    stdin = sys.stdin.read() if "-" in args.paths else None
    run = api.prepare(spark, args.paths, cwd, args.config, args.ext, args.as_format, args.exclude, args.gitignore, args.allow_empty, stdin)
    color = use_color(args.color)
    if args.verb == "validate":
        done = api.validate(run, args.schema, api.registry_of(run, args.offline), *_baseline(args, run.config.baseline))
        for line in done.report(args.format, args.quiet, color and args.format == "pretty"):
            say(line)
        return done.exit_code
    if args.verb == "get":
        for line in api.get(run, refs, args.format, args.quiet):
            say(line)
        return 0
    if args.verb == "fill":
        settings = run.config.fill
        threshold = args.confidence if args.confidence is not None else settings.get("confidence", FI.CONFIDENCE)
        if not 0 <= threshold <= 1:
            raise ValueError("the confidence must be between 0 and 1")
        whole = {}
        for key, given in (("maxTurns", args.max_turns), ("chunkChars", args.chunk_chars), ("concurrency", args.concurrency)):
            whole[key] = settings.get(key) if given is None else given
            if whole[key] is not None and whole[key] < 1:
                raise ValueError(f"{key} must be at least 1")
        only = frozenset(split_list(args.fields)) if args.fields else None
        options = FI.Options(threshold, int(whole["chunkChars"] or FI.CHUNK_CHARS), only, whole["maxTurns"], concurrency=whole["concurrency"])
        model = args.model or settings.get("model")
        provider = FI.pick_provider(_providers(args, model, cwd), args.provider or settings.get("provider"), model, args.local)
        cache = os.path.join(cwd, ".metaloom", "proposals.jsonl") if args.cache else None
        filled, counts = api.fill(run, provider, args.schema, api.registry_of(run, args.offline), options, args.dry_run, cache)
        rows = {"pretty": FI.pretty_rows, "json": FI.json_rows, "github": FI.github_rows}[args.format](filled)
        for row in rows.orderBy("file").toLocalIterator():
            say(row["line"])
        if args.format != "github":
            say(json.dumps(counts))
        return FI.exit_code(counts)
    found = api.infer(run, args.min_coverage)
    if args.format == "json":
        say(json.dumps(found.draft(), indent=2))
    else:
        for line in found.report(color):
            say(line)
    if args.out:
        sinks.write_atomic(os.path.join(cwd, args.out), json.dumps(found.draft(), indent=2) + "\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
