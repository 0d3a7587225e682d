"""The configuration file: YAML, the first one found on the way up to the repository's root."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from typing import Any

from metaloom.functions import yamls
from metaloom.operators.resolve import Override, Rules, Trust

from .registry import PIN, classify

NAMES = ("metaloom.config.yaml", "metaloom.config.yml")
MOST_TTL_HOURS = 8760
KEYS = ("paths", "exclude", "schemas", "overrides", "baseline", "allowEmpty", "respectGitignore", "offline", "schemaCache", "schemaTrust", "fill")
FILL_KEYS = {"provider": str, "model": str, "confidence": (0, 1), "maxTurns": (1, None), "chunkChars": (1, None), "concurrency": (1, 64)}


class ConfigError(ValueError):
    pass


@dataclass
class Config:
    folder: str = "."
    path: str | None = None
    paths: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    schemas: list[str] = field(default_factory=list)
    pins: dict[str, str] = field(default_factory=dict)
    sources: dict[str, str] = field(default_factory=dict)
    overrides: list[Override] = field(default_factory=list)
    baseline: str | bool | None = None
    allow_empty: bool | None = None
    respect_gitignore: bool | None = None
    offline: bool | None = None
    ttl_hours: float | None = None
    trust_mode: str = "any"
    trust_hosts: list[str] = field(default_factory=list)
    fill: dict[str, Any] = field(default_factory=dict)

    def rebased(self, ref: str, cwd: str) -> str:
        """A local file reference as an absolute path if the file lies elsewhere than the run."""
        if classify(ref) != "file" or os.path.abspath(self.folder) == os.path.abspath(cwd):
            return ref
        return os.path.abspath(os.path.join(self.folder, ref))

    def rules(self, cwd: str, cli: list[str] = (), published: tuple[str, ...] = ()) -> Rules:
        root = find_root(cwd) or self.folder or cwd
        trust = Trust(self.trust_mode, tuple(self.trust_hosts), root, published)
        overrides = tuple(Override(o.files, tuple(self.rebased(r, cwd) for r in o.schemas)) for o in self.overrides)
        return Rules(tuple(cli), overrides, tuple(self.rebased(r, cwd) for r in self.schemas), trust=trust)


def find_root(start: str) -> str | None:
    """The nearest folder above that holds .git."""
    at = os.path.abspath(start)
    while True:
        if os.path.exists(os.path.join(at, ".git")):
            return at
        if (up := os.path.dirname(at)) == at:
            return None
        at = up


def discover(cwd: str) -> str | None:
    """The first configuration file from ``cwd`` up to the repository's root."""
    at = os.path.abspath(cwd)
    while True:
        for name in NAMES:
            if os.path.isfile(os.path.join(at, name)):
                return os.path.join(at, name)
        if os.path.exists(os.path.join(at, ".git")) or (up := os.path.dirname(at)) == at:
            return None
        at = up


def _known(value: Any, keys: tuple[str, ...], where: str) -> dict[str, Any]:
    if not isinstance(value, dict):
        raise ConfigError(f"{where} must be a mapping")
    for key in value:
        if key not in keys:
            raise ConfigError(f"unknown key {key!r} in {where}; supported: {', '.join(keys)}")
    return value


def _strings(value: Any, where: str) -> list[str]:
    if not isinstance(value, list) or not all(isinstance(x, str) and x for x in value):
        raise ConfigError(f"{where} must be a list of strings")
    return value


def _flag(value: Any, where: str) -> bool:
    if not isinstance(value, bool):
        raise ConfigError(f"{where} must be true or false")
    return value


def _number(value: Any, low: float, high: float | None, where: str, whole: bool = False) -> float:
    good = isinstance(value, int | float) and not isinstance(value, bool) and value >= low and (high is None or value <= high) and (not whole or value == int(value))
    if not good:
        raise ConfigError(f"{where} must be a{' whole' * whole} number of at least {low}" + (f" and at most {high}" if high is not None else ""))
    return value


def parse(text: str, folder: str = ".", path: str | None = None) -> Config:
    try:
        body = yamls.parse(text.removeprefix("\ufeff"))
    except yamls.YamlError as e:
        raise ConfigError(f"{path or 'the configuration'} is not valid YAML: {e}") from None
    body = _known({} if body is None else body, KEYS, path or "the configuration")
    out = Config(folder, path)
    out.paths = _strings(body.get("paths", []), "paths")
    out.exclude = _strings(body.get("exclude", []), "exclude")
    for i, entry in enumerate(body.get("schemas") or []):
        if isinstance(entry, str):
            out.schemas.append(entry)
            continue
        entry = _known(entry, ("ref", "source", "integrity"), f"schemas[{i}]")
        ref = entry.get("ref")
        if not isinstance(ref, str) or not ref:
            raise ConfigError(f"schemas[{i}].ref must be a string")
        if "integrity" in entry:
            if classify(ref) != "file" or not PIN.match(str(entry["integrity"])):
                raise ConfigError(f"schemas[{i}].integrity must be sha256- and 64 hex digits, on a local file")
            out.pins[ref] = entry["integrity"]
        if "source" in entry:
            out.sources[ref] = str(entry["source"])
        out.schemas.append(ref)
    for i, entry in enumerate(body.get("overrides") or []):
        entry = _known(entry, ("files", "schemas"), f"overrides[{i}]")
        out.overrides.append(Override(tuple(_strings(entry.get("files"), f"overrides[{i}].files")), tuple(_strings(entry.get("schemas"), f"overrides[{i}].schemas"))))
    if "baseline" in body:
        if body["baseline"] is not False and not (isinstance(body["baseline"], str) and body["baseline"]):
            raise ConfigError("baseline must be a path or false")
        out.baseline = body["baseline"]
    for key, name in (("allowEmpty", "allow_empty"), ("respectGitignore", "respect_gitignore"), ("offline", "offline")):
        if key in body:
            setattr(out, name, _flag(body[key], key))
    if "schemaCache" in body:
        cache = _known(body["schemaCache"], ("ttlHours",), "schemaCache")
        if "ttlHours" in cache:
            out.ttl_hours = _number(cache["ttlHours"], 0, MOST_TTL_HOURS, "schemaCache.ttlHours")
    if "schemaTrust" in body:
        trust = _known(body["schemaTrust"], ("documentRefs", "hosts"), "schemaTrust")
        out.trust_mode = trust.get("documentRefs", "any")
        if out.trust_mode not in ("any", "local", "none"):
            raise ConfigError("schemaTrust.documentRefs must be any, local or none")
        out.trust_hosts = _strings(trust.get("hosts", []), "schemaTrust.hosts")
    for key, value in _known(body.get("fill") or {}, tuple(FILL_KEYS), "fill").items():
        rule = FILL_KEYS[key]
        if rule is str and not (isinstance(value, str) and value):
            raise ConfigError(f"fill.{key} must be a string")
        out.fill[key] = value if rule is str else _number(value, *rule, f"fill.{key}", whole=key != "confidence")
    return out


def load(cwd: str, explicit: str | bool | None = None) -> Config:
    """The explicit file, which must be there, or the one that is found, or nothing; False looks for none."""
    if explicit is False:
        return Config(cwd)
    path = os.path.join(cwd, explicit) if explicit else discover(cwd)
    if path is None:
        return Config(cwd)
    try:
        with open(path, encoding="utf-8") as f:
            return parse(f.read(), os.path.dirname(os.path.abspath(path)), path)
    except OSError as e:
        raise ConfigError(f"can't read {path}: {e.strerror}") from None
