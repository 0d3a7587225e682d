"""Report, fill, write and text-function queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.functions import text as T
from metaloom.operators import extract as X
from metaloom.operators import fill as FI
from metaloom.operators import resolve as S
from metaloom.operators import validate as V
from metaloom.operators import writers as W
from metaloom.reports import render as O
from metaloom.sources.builtins import BUILTINS, DEFAULT_SET
from metaloom.sources.registry import Registry

from . import rendering as R
from .governance import _checked, _pages


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.results(*_checked(_pages(spark, sf_dir), refs=list(DEFAULT_SET)))


def github(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.github_rows(_results(spark, sf_dir)).select("file", "line")


def junit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.junit_rows(_results(spark, sf_dir))


def pretty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.pretty_rows(_results(spark, sf_dir))


def sarif_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.sarif_rows(_results(spark, sf_dir)).groupBy("rule").agg(F.count("*").alias("n"))


def fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing types proposed by a table, gated, checked again and written: the types that were there or were filled."""
    pages = _pages(spark, sf_dir)
    resolved = S.resolve(X.extract(pages, keep=("content",)), S.Rules())
    provider = FI.MockProvider({"type": ("page", 0.9), "action": ("sleep", 0.95), "timestamp": ("2024-01-01T00:00:00Z", 0.2)})
    filled = FI.fill(resolved, Registry(), provider, list(DEFAULT_SET))
    fields = filled.select(F.explode("fields").alias("f"))
    return fields.groupBy(F.col("f.key").alias("key"), F.coalesce("f.reason", F.lit("written")).alias("outcome")).agg(F.count("*").alias("n"))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key set in YAML blocks of customers; the new text is read again."""
    c = R.table(spark, sf_dir, "customer")
    content = R.yaml(name=R.quoted(F.col("c_name")), segment=F.col("c_mktsegment"))
    patch = R.json_text(segment=F.concat(F.lit("new "), F.col("c_mktsegment")), nation=F.col("c_nationkey"))
    rows = c.select(F.concat(F.col("c_custkey").cast("string"), F.lit(".md")).alias("file"), F.lit("markdown").alias("format"), content.alias("content"), patch.alias("patch_json"))
    return W.patch_documents(rows).select("file", "content", "error")


def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(X.capabilities(), "name string, extensions string, writable boolean")


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, len(s["properties"]), ",".join(s.get("required", []))) for i, s in BUILTINS.items()], "id string, properties int, required string")


def escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string("%s: 5%%, <%s> & \"q\"\n", F.col("p_name"), F.col("p_brand"))
    return R.table(spark, sf_dir, "part").select("p_partkey", T.command_message(text).alias("message"), T.command_property(text).alias("property"), T.xml_text(text).alias("xml"))


def near_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.concat(F.substr(F.element_at(F.split("p_name", " "), 1), F.lit(1), F.lit(3)), F.lit("idate"))
    return R.table(spark, sf_dir, "part").select("p_partkey", F.levenshtein(words, F.lit("validate")).alias("distance"), T.nearest(words, ["validate", "get", "fill", "schemas"], 4).alias("nearest"))


QUERIES = {
    "report_github": github,
    "report_junit": junit,
    "report_pretty": pretty,
    "report_sarif_rules": sarif_rules,
    "fill_outcomes": fill,
    "write_yaml": patches,
    "list_formats": formats,
    "list_contracts": contracts,
    "text_escapes": escapes,
    "text_nearest": near_commands,
}

ORACLES = {
    "report_github": """SELECT 'docs/' || page_id || '.md' AS file,
        '::error file=docs/' || page_id || '.md,line=1::[google:okf:0.1] (root) must have required property ''type''' AS line FROM pages WHERE url NOT LIKE 'https://%'""",
    "report_junit": """SELECT 'docs/' || page_id || '.md' AS file, '    <testcase name="docs/' || page_id || '.md" classname="metaloom"' ||
        CASE WHEN url LIKE 'https://%' THEN '/>' ELSE '>' || chr(10) || '      <failure type="google:okf:0.1/required" message="(root) must have required property &apos;type&apos; (line 1)"/>' || chr(10) || '    </testcase>' END AS line FROM pages""",
    "report_pretty": """SELECT 'docs/' || page_id || '.md' AS file, CASE WHEN url LIKE 'https://%' THEN '✓ docs/' || page_id || '.md'
        ELSE '✗ docs/' || page_id || '.md' || chr(10) || '    (root)  must have required property ''type''  (line 1)  [google:okf:0.1]' END AS line FROM pages""",
    "report_sarif_rules": "SELECT 'google:okf:0.1/required' AS rule, count(*) AS n FROM pages WHERE url NOT LIKE 'https://%' HAVING count(*) > 0",
    "fill_outcomes": """SELECT key, outcome, n FROM (SELECT 'type' AS key, 'written' AS outcome, count(*) AS n FROM pages WHERE url NOT LIKE 'https://%'
        UNION ALL SELECT 'action', 'schema-mismatch', count(*) FROM pages UNION ALL SELECT 'timestamp', 'low-confidence', count(*) FROM pages
        UNION ALL SELECT 'description', 'no-proposal', count(*) FROM pages UNION ALL SELECT 'tags', 'no-proposal', count(*) FROM pages) WHERE n > 0""",
    "write_yaml": """SELECT c_custkey || '.md' AS file, '---' || chr(10) || 'name: "' || c_name || '"' || chr(10) || 'segment: new ' || c_mktsegment || chr(10) || 'nation: ' || c_nationkey || chr(10) || '---' || chr(10) || 'Text.' || chr(10) AS content,
        NULL::VARCHAR AS error FROM customer""",
    "list_formats": """SELECT * FROM (VALUES ('markdown', '.md,.markdown', true), ('mdx', '.mdx', true), ('asciidoc', '.adoc,.asciidoc', true), ('rst', '.rst', true),
        ('xml', '.xml,.dita,.ditamap', true), ('html', '.html,.htm', true)) AS t(name, extensions, writable)""",
    "list_contracts": """SELECT * FROM (VALUES ('google:okf:0.1', 6::INT, 'type'), ('diataxis:diataxis:1.0', 1, 'type'), ('passo-uno:seven-action:1.0', 1, ''), ('tgdp:templates:1.0', 1, 'type'),
        ('docusaurus:docs:3.10', 25, ''), ('docusaurus:blog:3.10', 20, ''), ('docusaurus:pages:3.10', 9, '')) AS t(id, properties, required)""",
    "text_escapes": r"""WITH t AS (SELECT p_partkey, p_name || ': 5%, <' || p_brand || '> & "q"' || chr(10) AS x FROM part)
      SELECT p_partkey, replace(replace(x, '%', '%25'), chr(10), '%0A') AS message, replace(replace(replace(replace(x, '%', '%25'), chr(10), '%0A'), ':', '%3A'), ',', '%2C') AS property,
        replace(replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(10), '&#10;') AS xml FROM t""",
    "text_nearest": """WITH t AS (SELECT p_partkey, left(split_part(p_name, ' ', 1), 3) || 'idate' AS w FROM part),
      d AS (SELECT p_partkey, w, levenshtein(w, n) AS d, i, n FROM t, (VALUES (0, 'validate'), (1, 'get'), (2, 'fill'), (3, 'schemas')) AS c(i, n))
      SELECT p_partkey, levenshtein(w, 'validate')::INT AS distance, CASE WHEN min(d) <= 4 THEN arg_min(n, d * 10 + i) END AS nearest FROM d GROUP BY p_partkey, w""",
}
