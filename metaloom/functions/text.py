"""Text functions of the reports, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


_COMMAND = [("%", "%25"), ("\r", "%0D"), ("\n", "%0A")]


def command_message(text: Column) -> Column:
    """Escaped for the message of a CI workflow command."""
    return _replaced(text, _COMMAND)


def command_property(text: Column) -> Column:
    """Escaped for a property of a CI workflow command."""
    return _replaced(text, [*_COMMAND, (":", "%3A"), (",", "%2C")])


def xml_text(text: Column) -> Column:
    """Escaped for XML, without the characters that XML can't hold."""
    kept = F.regexp_replace(text, r"[^\u0009\u000A\u000D\u0020-\uD7FF\uE000-\uFFFD\x{10000}-\x{10FFFF}]", "")
    return _replaced(kept, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")])


def field_label(path: Column) -> Column:
    return F.when(path == "", F.lit("(root)")).otherwise(path)


def rule_id(schema: Column, keyword: Column) -> Column:
    own = schema == "(parse)"
    return F.when(own & (keyword == "parse"), F.lit("parse-error")).when(own & (keyword == "schema"), F.lit("schema-error")).otherwise(F.concat_ws("/", schema, keyword))


def split_list(text: Column) -> Column:
    """The parts of a comma list, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def nearest(word: Column, names: list[str], most: int = 2) -> Column:
    """The name nearest by edit distance, if it is within ``most``."""
    each = F.array(*[F.struct(F.levenshtein(word, F.lit(n)).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(names)])
    best = F.array_min(each)
    return F.when(best["d"] <= most, best["n"])


def vendor_file_name(url: Column) -> Column:
    """A file name for a schema's URL: host and path, odd characters as dashes."""
    path = F.coalesce(F.try_url_decode(F.parse_url(url, F.lit("PATH"))), F.parse_url(url, F.lit("PATH")))
    name = F.regexp_replace(F.concat(F.parse_url(url, F.lit("HOST")), path), r"[^A-Za-z0-9._-]+", "-")
    trimmed = F.regexp_replace(name, r"^[-.]+|[-.]+$", "")
    return F.when(F.lower(trimmed).endswith(".json"), trimmed).otherwise(F.concat(trimmed, F.lit(".json")))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def percent(x: Column) -> Column:
    return F.format_string("%.1f%%", x)
