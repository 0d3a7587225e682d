"""Documents rendered from table rows, in the formats that are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(rows: DataFrame) -> DataFrame:
    """The rows over all cores if their files are too small to be split for them; large tables stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def json_text(**fields: Column) -> Column:
    """A JSON object; null fields are left out."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def quoted(value: Column) -> Column:
    """A string as JSON text, which YAML and TOML read alike."""
    text = F.to_json(F.array(value.cast("string")))
    return F.substr(text, F.lit(2), F.length(text) - 2)


def _lines(fields: dict[str, Column], form: str) -> Column:
    each = [F.when(c.isNotNull(), F.format_string(form, F.lit(k), c)) for k, c in fields.items()]
    return F.array_join(F.filter(F.array(*each), lambda x: x.isNotNull()), "")


def yaml(body: str = "Text.\n", **fields: Column) -> Column:
    return F.concat(F.lit("---\n"), _lines(fields, "%s: %s\n"), F.lit("---\n" + body))


def toml(body: str = "Text.\n", **fields: Column) -> Column:
    return F.concat(F.lit("+++\n"), _lines(fields, "%s = %s\n"), F.lit("+++\n" + body))


def json_block(body: str = "Text.\n", **fields: Column) -> Column:
    return F.concat(F.lit(";;;\n"), json_text(**fields), F.lit("\n;;;\n" + body))


def asciidoc(title: Column, body: str = "\nText.\n", **fields: Column) -> Column:
    return F.concat(F.lit("= "), title, F.lit("\n"), _lines(fields, ":%s: %s\n"), F.lit(body))


def rst(title: Column, body: str = "\nText.\n", **fields: Column) -> Column:
    rule = F.repeat(F.lit("="), F.char_length(title))
    return F.concat(rule, F.lit("\n"), title, F.lit("\n"), rule, F.lit("\n\n"), _lines(fields, ":%s: %s\n"), F.lit(body))


def xml_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def dita(**fields: Column) -> Column:
    each = [F.when(c.isNotNull(), F.format_string('<othermeta name="%s" content="%s"/>\n', F.lit(k), xml_escape(c))) for k, c in fields.items()]
    metas = F.array_join(F.filter(F.array(*each), lambda x: x.isNotNull()), "")
    return F.concat(F.lit('<topic id="t">\n<title>T</title>\n<prolog><metadata>\n'), metas, F.lit("</metadata></prolog>\n</topic>\n"))
