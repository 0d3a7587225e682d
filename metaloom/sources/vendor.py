"""Vendoring: a remote contract as a pinned local file and a configuration entry."""

from __future__ import annotations

import os
import re
import urllib.parse
from typing import Any

from metaloom.operators.jsonschema import SchemaError

from .registry import Registry, classify, digest, parse_contract
from .sinks import refuse_target, write_atomic


def file_name(url: str) -> str:
    parts = urllib.parse.urlsplit(url)
    name = re.sub(r"[^A-Za-z0-9._-]+", "-", (parts.hostname or "") + urllib.parse.unquote(parts.path)).strip("-.")
    return name if name.lower().endswith(".json") else name + ".json"


def fold(entries: list[Any], ref: str, source: str, integrity: str) -> list[Any]:
    """The configuration's schemas with the pinned one in the place of its URL, or at the end."""
    new = {"ref": ref, "source": source, "integrity": integrity}
    name = lambda e: e if isinstance(e, str) else e.get("ref")
    out, done = [], False
    for e in entries:
        if name(e) in (ref, source) or (isinstance(e, dict) and e.get("source") == source):
            if not done:
                out.append(new)
            done = True
        else:
            out.append(e)
    return out if done else [*out, new]


def vendor(url: str, registry: Registry, folder: str, cwd: str = ".", entries: list[Any] = ()) -> tuple[str, list[Any]]:
    """(path, schema entries): checks the target, fetches, hashes and writes, in this order."""
    if classify(url) != "url":
        raise SchemaError(f"{url} is no URL")
    path = os.path.join(folder, file_name(url))
    refuse_target(path, cwd, force=True)
    raw = registry.fetch(url)
    parse_contract(raw.decode("utf-8", "replace"), url, guard=True)
    os.makedirs(os.path.join(cwd, folder), exist_ok=True)
    write_atomic(os.path.join(cwd, path), raw.decode("utf-8"))
    return path, fold(list(entries), path.replace(os.sep, "/"), url, digest(raw))
