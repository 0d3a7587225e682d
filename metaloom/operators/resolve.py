"""The contracts of each document: command line, document, override, config, default."""

from __future__ import annotations

import os
import re
import urllib.parse
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloom.sources.builtins import BUILTINS, DEFAULT_SET
from metaloom.sources.registry import classify


def glob_regex(glob: str) -> str:
    """A path glob as a regular expression, dot files included; forms: ** * ? [..] {a,b} !(..) not."""
    out, i, depth = "", 0, 0
    glob = glob.replace("\\", "/")
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out, i = out + "(?:/.*)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
        elif c == "{":
            out, i, depth = out + "(?:", i + 1, depth + 1
        elif c == "}" and depth:
            out, i, depth = out + ")", i + 1, depth - 1
        elif c == "," and depth:
            out, i = out + "|", i + 1
        else:
            out, i = out + re.escape(c), i + 1
    return f"^{out}$"


@dataclass(frozen=True)
class Override:
    files: tuple[str, ...]
    schemas: tuple[str, ...]


@dataclass(frozen=True)
class Trust:
    """Which references a document may choose: "any", "local" (built-in, or a file under ``root``) or "none"."""

    mode: str = "any"
    hosts: tuple[str, ...] = ()
    root: str = "."
    published: tuple[str, ...] = ()

    def refusal(self, ref: str) -> str | None:
        """Why a document's reference is refused; None if it is trusted."""
        kind = classify(ref)
        if kind == "builtin" or ref in self.published:
            return None
        if kind == "url":
            parts = urllib.parse.urlsplit(ref)
            host, name = parts.netloc.lower().rpartition("@")[2], (parts.hostname or "").lower()
            allowed = {h.lower() for h in self.hosts}
            if allowed and not {host, name} & allowed:
                return f"the host of {ref} is not allowed"
            return f"{ref} is remote, and only local schemas are trusted" if self.mode == "local" and not allowed else None
        if self.mode == "local":
            root = os.path.realpath(self.root)
            if os.path.commonpath([root, os.path.realpath(os.path.join(root, ref))]) != root:
                return f"{ref} lies outside of {root}"
        return None


@dataclass(frozen=True)
class Rules:
    cli: tuple[str, ...] = ()
    overrides: tuple[Override, ...] = ()
    config: tuple[str, ...] = ()
    default: tuple[str, ...] = DEFAULT_SET
    trust: Trust = field(default_factory=Trust)


def _refs(refs: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(r) for r in dict.fromkeys(refs)]) if refs else F.array().cast("array<string>")


def resolve(extracted: DataFrame, rules: Rules) -> DataFrame:
    """``extracted`` with ``schemas`` (array), ``source`` and ``schema_error``.

    All of it is column expressions: the document's ``$schema`` is read from the
    object's JSON as a VARIANT, overrides are an ordered CASE of path patterns.
    """
    data = F.try_parse_json("data_json")
    own = F.try_variant_get(data, "$['$schema']", "variant")
    kind = F.schema_of_variant(own)
    listed = F.try_variant_get(own, "$", "array<variant>")
    all_strings = F.coalesce(F.forall(listed, lambda x: F.schema_of_variant(x) == "STRING"), F.lit(False))
    document = F.when(kind == "STRING", F.array(F.try_variant_get(own, "$", "string"))).when(kind.startswith("ARRAY") & all_strings, F.try_variant_get(own, "$", "array<string>"))
    malformed = own.isNotNull() & ~F.coalesce(F.is_variant_null(own), F.lit(False)) & document.isNull()
    override = F.lit(None).cast("array<string>")
    for rule in reversed(rules.overrides):
        if rule.schemas:
            matches = F.lit(False)
            for glob in rule.files:
                matches = matches | F.col("file").rlike(glob_regex(glob))
            override = F.when(matches, _refs(rule.schemas)).otherwise(override)
    named = F.size(F.coalesce(document, F.array())) > 0
    if rules.trust.mode == "none":
        named = F.lit(False)
    choices = [
        (F.lit(bool(rules.cli)), _refs(rules.cli), "cli"),
        (named, F.array_distinct(document), "document"),
        (override.isNotNull(), override, "override"),
        (F.lit(bool(rules.config)), _refs(rules.config), "config"),
    ]
    schemas, source = _refs(rules.default), F.lit("default")
    for holds, refs, name in reversed(choices):
        schemas = F.when(holds, refs).otherwise(schemas)
        source = F.when(holds, F.lit(name)).otherwise(source)
    out = extracted.withColumns({"schemas": schemas, "source": source})
    problem = F.when(malformed & F.lit(not rules.cli and rules.trust.mode != "none"), F.lit("$schema must be a string or a list of strings"))
    trust = rules.trust
    if trust.mode == "local" or trust.hosts:

        @F.pandas_udf("string")
        def refused(refs):
            return refs.map(lambda r: next((why for x in (r if r is not None else ()) if (why := trust.refusal(x))), None))

        problem = F.coalesce(problem, F.when(F.col("source") == "document", refused("schemas")))
    return out.withColumn("schema_error", problem)


def is_published(ref: str, aliases: dict[str, str]) -> bool:
    return aliases.get(ref) in BUILTINS


def classify_column(ref: Column) -> Column:
    """``classify`` of a column of references."""
    builtin = ref.rlike(r"^[\w-]+:[\w.-]+:[\w.-]+$") & ~ref.rlike(r"^[A-Za-z]:[\\/]")
    return F.when(ref.rlike(r"(?i)^https?://"), F.lit("url")).when(builtin, F.lit("builtin")).otherwise("file")


def host_allowed(ref: Column, hosts: list[str]) -> Column:
    """Whether a URL's host, or host with port, is among the allowed ones, in any case."""
    authority = F.lower(F.regexp_extract(ref, r"(?i)^https?://(?:[^/@]*@)?([^/?#]*)", 1))
    name = F.regexp_replace(authority, r":\d+$", "")
    allowed = [h.lower() for h in hosts]
    return authority.isin(allowed) | name.isin(allowed)


def refused_by_hosts(refs: DataFrame, hosts: list[str]) -> DataFrame:
    """The URL references of (file, ref) rows whose host isn't allowed."""
    return refs.where((classify_column(F.col("ref")) == "url") & ~host_allowed(F.col("ref"), hosts))
