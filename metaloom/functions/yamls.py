"""YAML 1.2 core schema on top of PyYAML's composer, with source marks.

Timestamps stay strings, ``yes``/``no``/``on``/``off`` are strings, ``0o17`` is octal and
``<<`` is a plain key.
"""

from __future__ import annotations

import re
from typing import Any

try:
    import yaml
except ImportError:  # pragma: no cover
    yaml = None

from .pointers import escape

MOST_ALIASES = 100
_FAST = getattr(yaml, "CSafeLoader", None)

_NULL = re.compile(r"^(?:~|null|Null|NULL)?$")
_BOOL = re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$")
_INT = re.compile(r"^[-+]?[0-9]+$")
_OCTAL, _HEX = re.compile(r"^0o[0-7]+$"), re.compile(r"^0x[0-9a-fA-F]+$")
_FLOAT = re.compile(r"^[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?$")
_INF, _NAN = re.compile(r"^[-+]?\.(?:inf|Inf|INF)$"), re.compile(r"^\.(?:nan|NaN|NAN)$")


class YamlError(ValueError):
    pass


def plain_scalar(text: str) -> Any:
    """The value of an unquoted scalar."""
    if _NULL.match(text):
        return None
    if _BOOL.match(text):
        return text[0] in "tT"
    if _INT.match(text):
        return int(text)
    if _OCTAL.match(text):
        return int(text[2:], 8)
    if _HEX.match(text):
        return int(text, 16)
    if _FLOAT.match(text):
        return float(text)
    if _INF.match(text):
        return float("-inf") if text[0] == "-" else float("inf")
    if _NAN.match(text):
        return float("nan")
    return text


def compose(text: str, exact: bool = False) -> Any:
    """The root node, or None for an empty document.

    Texts of printable ASCII without tags are read by the faster C parser where there
    is one; ``exact`` wants nodes whose marks are offsets into the text.
    """
    if yaml is None:
        raise YamlError("PyYAML isn't installed")
    plain = not exact and _FAST is not None and "!" not in text and text.isascii()
    try:
        loader = (_FAST if plain else yaml.SafeLoader)(text)
        try:
            return loader.get_single_node()
        finally:
            loader.dispose()
    except yaml.YAMLError as e:
        mark = getattr(e, "problem_mark", None)
        where = f" at line {mark.line + 1}, column {mark.column + 1}" if mark else ""
        raise YamlError(f"{getattr(e, 'problem', None) or e}{where}") from None


def construct(root: Any) -> Any:
    """The value of a node; repeated keys and alias bombs are errors."""
    done: dict[int, Any] = {}
    uses = 0

    def build(node: Any, above: tuple[int, ...]) -> Any:
        nonlocal uses
        if id(node) in above:
            raise YamlError("an alias refers to its own content")
        if id(node) in done and not isinstance(node, yaml.ScalarNode):
            uses += 1
            if uses > MOST_ALIASES:
                raise YamlError("Excessive alias count indicates a resource exhaustion attack")
        if isinstance(node, yaml.ScalarNode):
            if not node.style and not _tagged(node):
                return plain_scalar(node.value)
            return node.value
        inside = (*above, id(node))
        if isinstance(node, yaml.SequenceNode):
            out: Any = [build(x, inside) for x in node.value]
        else:
            out = {}
            for k, v in node.value:
                key = key_text(k)
                if key in out:
                    raise YamlError(f"Map keys must be unique at line {k.start_mark.line + 1}, column {k.start_mark.column + 1}")
                out[key] = build(v, inside)
        done[id(node)] = out
        return out

    return build(root, ())


def _tagged(node: Any) -> bool:
    mark = node.start_mark
    return mark.buffer is not None and mark.buffer[mark.pointer : mark.pointer + 1] == "!"


def key_text(node: Any) -> str:
    if not isinstance(node, yaml.ScalarNode):
        raise YamlError("a key that is no scalar")
    return node.value


def lines(root: Any, ahead: int) -> dict[str, int]:
    """Pointer to line of every key and item, ``ahead`` lines after the block's start."""
    out: dict[str, int] = {}

    def walk(node: Any, pointer: str, depth: int) -> None:
        if depth > 200:
            return
        if isinstance(node, yaml.MappingNode):
            for k, v in node.value:
                child = f"{pointer}/{escape(key_text(k))}"
                out[child] = k.start_mark.line + 1 + ahead
                walk(v, child, depth + 1)
        elif isinstance(node, yaml.SequenceNode):
            for i, item in enumerate(node.value):
                out[f"{pointer}/{i}"] = item.start_mark.line + 1 + ahead
                walk(item, f"{pointer}/{i}", depth + 1)

    if root is not None:
        walk(root, "", 0)
    return out


def parse(text: str) -> Any:
    node = compose(text)
    return None if node is None else construct(node)


def scalar_or_raw(raw: str) -> Any:
    """A native value: read as YAML, or as it stands if it isn't any."""
    try:
        return parse(raw)
    except (YamlError, RecursionError):
        return raw
