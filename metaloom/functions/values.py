"""The value domain: JSON plus a date marker, and its text forms.

A value is None, bool, int, float, str, list, dict or ``Moment`` (an unquoted TOML
date or time, which is no string).  In ``data_json`` a moment is an object with the
single key ``MOMENT``.
"""

from __future__ import annotations

import datetime
import json
import math
import re
from typing import Any

MOMENT = "$moment"


class Moment:
    """An unquoted date or time, kept by its ISO text."""

    __slots__ = ("text",)

    def __init__(self, value: datetime.datetime | datetime.date | datetime.time | str):
        if isinstance(value, datetime.datetime) and value.tzinfo is not None:
            value = value.astimezone(datetime.UTC).replace(tzinfo=None)
            self.text = value.isoformat(timespec="milliseconds") + "Z"
        else:
            self.text = value if isinstance(value, str) else value.isoformat()

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Moment) and self.text == other.text

    def __hash__(self) -> int:
        return hash(self.text)

    def __repr__(self) -> str:
        return f"Moment({self.text!r})"


def number_text(x: float) -> str:
    """A number as JavaScript prints it: 1.0 is 1."""
    if isinstance(x, int):
        return str(x)
    if math.isnan(x) or math.isinf(x):
        return "null"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    text = repr(x)
    mantissa, e, exponent = text.partition("e")
    return f"{mantissa}e{'+' if int(exponent) > 0 else ''}{int(exponent)}" if e else text


def dump(value: Any, indent: int | None = None, sort: bool = False, moments: bool = False) -> str:
    """JSON text. With ``moments`` dates keep their marker, otherwise they are strings."""

    def write(v: Any, level: int) -> str:
        if v is None:
            return "null"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, int | float):
            return number_text(v)
        if isinstance(v, str):
            return json.dumps(v, ensure_ascii=False)
        if isinstance(v, Moment):
            return write({MOMENT: v.text} if moments else v.text, level)
        items = sorted(v.items()) if sort and isinstance(v, dict) else v.items() if isinstance(v, dict) else v
        parts = [f"{json.dumps(str(k), ensure_ascii=False)}:{' ' * (indent is not None)}{write(x, level + 1)}" for k, x in items] if isinstance(v, dict) else [write(x, level + 1) for x in items]
        open_, close = "{}" if isinstance(v, dict) else "[]"
        if not parts or indent is None:
            return open_ + ",".join(parts) + close
        pad = "\n" + " " * indent * (level + 1)
        return open_ + pad + ("," + pad).join(parts) + "\n" + " " * indent * level + close

    return write(value, 0)


def load(text: str) -> Any:
    """``dump(..., moments=True)`` back."""

    def revive(x: dict) -> Any:
        return Moment(x[MOMENT]) if len(x) == 1 and MOMENT in x else x

    return json.loads(text, object_hook=revive)


def canonical(value: Any) -> str:
    """JSON text with sorted keys, equal for deeply equal values."""
    return dump(value, sort=True, moments=True)


def same(a: Any, b: Any) -> bool:
    return canonical(a) == canonical(b)


def type_name(value: Any) -> str:
    """The type as a profile names it; a date counts as a string."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int | float):
        return "number"
    if isinstance(value, str | Moment):
        return "string"
    return "array" if isinstance(value, list) else "object"


DATE = re.compile(r"^\d{4}-\d{2}-\d{2}$")
