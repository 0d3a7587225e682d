"""Loading contracts: built-in, file or URL, with a memo, a disk cache and integrity pins."""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from metaloom.operators.jsonschema import KEYWORDS, Evaluator, SchemaError

from .builtins import BUILTINS

TIMEOUT_S, RETRY_S, MOST_BYTES = 10, 0.5, 5 * 1024 * 1024
TTL_S, FUTURE_S = 24 * 3600, 60
PIN = re.compile(r"sha256-[0-9a-f]{64}\Z")


def classify(ref: str) -> str:
    """"url", "builtin" or "file"."""
    if re.match(r"https?://", ref, re.I):
        return "url"
    if re.match(r"[\w-]+:[\w.-]+:[\w.-]+\Z", ref, re.ASCII) and not re.match(r"[A-Za-z]:[\\/]", ref):
        return "builtin"
    return "file"


def strip_bom(text: str) -> str:
    return text.removeprefix("\ufeff")


def digest(raw: bytes) -> str:
    return f"sha256-{hashlib.sha256(raw).hexdigest()}"


def check_pin(raw: bytes, pin: str, ref: str) -> None:
    if not PIN.match(pin):
        raise SchemaError(f"{ref}: an integrity pin is sha256- and 64 lower-case hex digits")
    if digest(raw) == pin:
        return
    other = raw.replace(b"\r\n", b"\n")
    if pin in (digest(other), digest(other.replace(b"\n", b"\r\n"))):
        raise SchemaError(f"{ref}: integrity mismatch; only the line endings differ")
    raise SchemaError(f"{ref}: integrity mismatch; the content has changed")


def parse_contract(text: str, ref: str, guard: bool = False) -> Any:
    """A schema from text; ``guard`` wants an object with a keyword, as a fetched one must be."""
    try:
        schema = json.loads(strip_bom(text))
    except ValueError as e:
        where = f"line {e.lineno}, column {e.colno}" if isinstance(e, json.JSONDecodeError) else "unknown place"
        raise SchemaError(f"{ref} is not valid JSON ({where})") from None
    if guard and not (isinstance(schema, dict) and KEYWORDS & schema.keys()):
        raise SchemaError(f"{ref} holds no JSON Schema")
    return schema


def http_fetch(url: str) -> bytes:
    """At most two requests; only network trouble and server errors are tried again."""
    for attempt in (0, 1):
        try:
            with urllib.request.urlopen(url, timeout=TIMEOUT_S) as answer:
                raw = answer.read(MOST_BYTES + 1)
            if len(raw) > MOST_BYTES:
                raise SchemaError(f"{url} is larger than {MOST_BYTES} bytes")
            return raw
        except urllib.error.HTTPError as e:
            if e.code < 500 or attempt:
                raise SchemaError(f"{url}: HTTP {e.code}") from None
        except OSError as e:
            if attempt:
                raise SchemaError(f"{url}: {e}") from None
        time.sleep(RETRY_S)
    raise AssertionError


@dataclass
class DiskCache:
    """Fetched schemas by the hash of their URL; whatever is wrong with an entry is a miss."""

    folder: str
    ttl_s: float = TTL_S

    def _path(self, url: str) -> str:
        return os.path.join(self.folder, f"{hashlib.sha256(url.encode()).hexdigest()}.json")

    def read(self, url: str, offline: bool = False) -> bytes | None:
        if self.ttl_s <= 0 and not offline:
            return None
        try:
            age = time.time() - os.stat(self._path(url)).st_mtime
            if not offline and not -FUTURE_S <= age <= self.ttl_s:
                return None
            with open(self._path(url), "rb") as f:
                raw = f.read(MOST_BYTES + 1)
            parse_contract(raw.decode(), url, guard=True)
            return raw
        except (OSError, SchemaError, UnicodeDecodeError):
            return None

    def write(self, url: str, raw: bytes) -> None:
        if self.ttl_s <= 0:
            return
        os.makedirs(self.folder, exist_ok=True)
        temporary = f"{self._path(url)}.{os.getpid()}"
        with open(temporary, "wb") as f:
            f.write(raw)
        os.replace(temporary, self._path(url))


@dataclass
class Registry:
    """Loads and compiles contracts once a session. ``aliases`` maps published URLs to built-in ids."""

    cwd: str = "."
    offline: bool = False
    fetch: Callable[[str], bytes] = http_fetch
    cache: DiskCache | None = None
    pins: dict[str, str] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)
    extra: dict[str, Any] = field(default_factory=dict)
    loaded: dict[str, Any] = field(default_factory=dict)
    compiled: dict[str, Evaluator] = field(default_factory=dict)

    def load(self, ref: str) -> Any:
        if ref not in self.loaded:
            self.loaded[ref] = self._load(ref)  # a failure isn't kept
        return self.loaded[ref]

    def _load(self, ref: str) -> Any:
        if ref in self.extra:
            return self.extra[ref]
        kind = classify(ref)
        if ref in self.aliases and self.aliases[ref] in BUILTINS:
            return BUILTINS[self.aliases[ref]]
        if kind == "builtin":
            if ref not in BUILTINS:
                raise SchemaError(f"unknown built-in schema {ref}; there are: {', '.join(BUILTINS)}")
            return BUILTINS[ref]
        if kind == "file":
            try:
                with open(os.path.join(self.cwd, ref), "rb") as f:
                    raw = f.read()
            except OSError as e:
                raise SchemaError(f"can't read schema {ref}: {e.strerror}") from None
            if ref in self.pins:
                check_pin(raw, self.pins[ref], ref)
            return parse_contract(raw.decode("utf-8", "replace"), ref)
        cached = self.cache.read(ref, self.offline) if self.cache else None
        if cached is not None:
            return parse_contract(cached.decode(), ref, guard=True)
        if self.offline:
            raise SchemaError(f"{ref} isn't cached, and the run is offline")
        raw = self.fetch(ref)
        schema = parse_contract(raw.decode("utf-8", "replace"), ref, guard=True)
        if self.cache:
            self.cache.write(ref, raw)
        return schema

    def compile(self, ref: str) -> Evaluator:
        if ref not in self.compiled:
            known = {**BUILTINS, **{url: BUILTINS[i] for url, i in self.aliases.items() if i in BUILTINS}}
            self.compiled[ref] = Evaluator(self.load(ref), known)
        return self.compiled[ref]


def catalog() -> list[tuple[str, str]]:
    """(id, title) of every built-in contract."""
    return [(i, s["title"]) for i, s in BUILTINS.items()]
