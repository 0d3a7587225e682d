"""Queries of the rarer shapes: stray fences, byte order marks, typed meta tags, DITA by other signs, writers, samples, whole reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.functions import values
from metaloom.functions.pointers import look_up_column
from metaloom.operators import baseline as B
from metaloom.operators import extract as X
from metaloom.operators import fields as G
from metaloom.operators import fill as FI
from metaloom.operators import infer as I
from metaloom.operators import resolve as S
from metaloom.operators import validate as V
from metaloom.operators import writers as W
from metaloom.reports import profile as P
from metaloom.reports import render as O
from metaloom.sources.builtins import DEFAULT_SET
from metaloom.sources.registry import Registry

from . import rendering as R
from .governance import _checked, _pages


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = R.table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("nm"), F.col("s_nationkey").cast("string").alias("n"))


def _read(documents: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """file, format, present, and of each key its JSON text, line and column."""
    found = X.extract(documents)
    data = F.try_parse_json("data_json")
    columns = []
    for key in keys:
        columns += [
            F.to_json(F.try_variant_get(data, f"$['{key}']", "variant")).alias(key),
            look_up_column(F.col("lines"), F.lit(f"/{key}")).alias(f"{key}_line"),
            look_up_column(F.col("cols"), F.lit(f"/{key}")).alias(f"{key}_col"),
        ]
    return found.select("file", "format", "present", *columns)


def odd_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fences that never close, byte order marks, carriage returns and comments."""
    k, nm, n = F.col("k"), F.col("nm"), F.col("n")
    shape = k % 5
    file = F.concat(k.cast("string"), F.when(shape == 0, F.lit(".adoc")).when(shape == 1, F.lit(".rst")).when(shape == 2, F.lit(".md")).when(shape == 3, F.lit(".mdx")).otherwise(F.lit(".asciidoc")))
    rule = F.repeat(F.lit("="), F.char_length(nm))
    content = (
        F.when(shape == 0, F.concat(F.lit("---\n= "), nm, F.lit("\n:nation: "), n, F.lit("\n\nText.\n")))
        .when(shape == 1, F.concat(F.lit("---\n"), nm, F.lit("\n"), rule, F.lit("\n\n:nation: "), n, F.lit("\n\nText.\n")))
        .when(shape == 2, F.concat(F.lit("﻿---\r\ntitle: "), R.quoted(nm), F.lit("\r\n# a comment\r\nnation: "), n, F.lit("\r\n---\r\nText.\r\n")))
        .when(shape == 3, F.concat(F.lit("---\ntitle: "), R.quoted(nm), F.lit("\nno end\n")))
        .otherwise(F.concat(F.lit("= "), nm, F.lit("\n:!nation:\n:draft:\n\nText.\n")))
    )
    return _read(_suppliers(spark, sf_dir).select(file.alias("file"), content.alias("content")), ("title", "nation", "draft")).select("file", "format", "present", "title", "title_line", "nation", "nation_line", "draft")


def html_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed ``<meta>`` values, the last one winning, properties, a title that a meta beats, columns of ``content=``."""
    k, nm, n = F.col("k").cast("string"), F.col("nm"), F.col("n")
    late = F.when(F.col("k") % 2 == 0, F.concat(F.lit('<meta name="title" content="'), nm, F.lit(' &amp; more">\n'))).otherwise("")
    page = F.concat(F.lit("<html><head>\n<title>Page &lt;"), k, F.lit('&gt;</title>\n<meta name="nation" content="no">\n<meta content="'), n, F.lit('" name="nation">\n<meta property="flag"\n content="true">\n<meta name="empty" content="">\n<meta name="lost">\n'), late, F.lit("</head><body>x</body></html>\n"))
    found = _read(_suppliers(spark, sf_dir).select(F.concat(k, F.lit(".html")).alias("file"), page.alias("content")), ("title", "nation", "flag", "empty", "lost"))
    return found.select("file", "title", "title_line", "nation", "nation_line", "nation_col", "flag", "flag_line", "flag_col", "empty", "lost")


def dita_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What makes XML a DITA document: its type, a class, a version, its name and extension; a comment doesn't."""
    shape = F.col("k") % 6
    meta = F.concat(F.lit('<prolog><metadata><othermeta name="nation" content="'), F.col("n"), F.lit('"/></metadata></prolog>'))
    topic = F.concat(F.lit("<title>t</title>"), meta, F.lit("</topic>\n"))
    content = (
        F.when(shape == 0, F.concat(F.lit('<!DOCTYPE topic PUBLIC "-//OASIS//DTD DITA Topic//EN" "topic.dtd">\n<topic id="a">'), topic))
        .when(shape == 1, F.concat(F.lit('<topic id="a" class="- topic/topic ">'), topic))
        .when(shape == 2, F.concat(F.lit('<topic xmlns:d="urn:x" d:DITAArchVersion="1.3" id="a">'), topic))
        .when(shape == 3, F.concat(F.lit('<topic id="a">'), topic))
        .when(shape == 4, F.concat(F.lit('<!-- <!DOCTYPE topic PUBLIC "-//OASIS//DTD DITA Topic//EN" "x"> -->\n<topic id="a">'), topic))
        .otherwise(F.concat(F.lit('<map id="a"><topicmeta><othermeta name="nation" content="'), F.col("n"), F.lit('"/></topicmeta></map>\n')))
    )
    file = F.concat(F.col("k").cast("string"), F.when(shape == 3, F.lit(".dita")).when(shape == 5, F.lit(".ditamap")).otherwise(F.lit(".xml")))
    return _read(_suppliers(spark, sf_dir).select(file.alias("file"), content.alias("content")), ("id", "nation")).select("file", "format", "present", "id", "nation")


def written_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key changed and one added in every format that can be written, and two that are refused."""
    s = _suppliers(spark, sf_dir)
    k, n = F.col("k").cast("string"), F.col("n")

    def rows(name: str, ext: str, content: Column, **patch: Column) -> DataFrame:
        return s.select(F.concat(k, F.lit(ext)).alias("file"), F.lit(name).alias("format"), content.alias("content"), R.json_text(**patch).alias("patch_json"))

    both = {"nation": F.concat(F.lit("N"), n), "added": F.col("k")}
    dita = F.concat(F.lit('<topic id="t">\n<title>T</title>\n<prolog><metadata>\n<othermeta name="nation" content="'), n, F.lit('"/>\n</metadata></prolog>\n</topic>\n'))
    parts = [
        rows("mdx", ".toml.mdx", F.concat(F.lit("+++\nnation = "), n, F.lit("\n\n[t]\nx = 1\n+++\nText.\n")), **both),
        rows("markdown", ".json.md", F.concat(F.lit(';;;\n{\n  "nation": '), n, F.lit("\n}\n;;;\nText.\n")), **both),
        rows("asciidoc", ".adoc", F.concat(F.lit("---\nnation: "), n, F.lit("\n---\n= T\n")), **both),
        rows("asciidoc", ".bare.adoc", F.concat(F.lit("= T\n:nation: "), n, F.lit("\n")), **both),
        rows("html", ".html", F.concat(F.lit('<html><head>\n<meta name="nation" content="'), n, F.lit('">\n</head></html>\n')), **both),
        rows("html", ".bare.html", F.lit("<p>x</p>\n"), **both),
        rows("xml", ".xml", F.concat(F.lit('<?xml version="1.0"?>\n<doc nation="'), n, F.lit('"><a/></doc>\n')), **both),
        rows("xml", ".dita", dita, nation=both["nation"]),
    ]
    united = parts[0]
    for part in parts[1:]:
        united = united.unionAll(part)
    return W.patch_documents(united).select("file", F.replace("content", F.lit("\n"), F.lit("|")).alias("content"), F.col("error").isNotNull().alias("refused"))


def _profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile of orders as documents: a date, a time stamp, an address, a name that may be empty and one that is rare."""
    o = R.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    found = I.occurrences_of_map(
        o.select(key.cast("string").alias("file"), key.alias("file_ord"), day.alias("day"), "o_orderstatus", "o_orderpriority"),
        {
            "day": R.quoted(F.col("day")),
            "stamp": R.quoted(F.concat("day", F.lit("T10:00:00Z"))),
            "link": R.quoted(F.concat(F.lit("https://x.test/"), "o_orderpriority")),
            "status": R.quoted(F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(F.col("o_orderstatus"))),
            "rare": F.when(F.col("file_ord") % 50 == 0, R.quoted(F.concat(F.lit("r"), F.col("file")))),
        },
    )
    return I.profile(found, o.count())


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiled(spark, sf_dir).select("key", "present", "sample", "format", "has_empty")


def covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of a report with at least half coverage, numbered in its order."""
    rows = [(i, r["key"]) for i, r in enumerate(I.report_order(_profiled(spark, sf_dir), 50.0).select("key").collect(), 1)]
    return spark.createDataFrame(rows, "place int, key string")


def drafted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The draft contract's rules."""
    rules = I.draft(_profiled(spark, sf_dir))["properties"]
    return spark.createDataFrame([(i, k, r["type"], r.get("minLength"), len(r.get("enum", []))) for i, (k, r) in enumerate(rules.items(), 1)], "place int, key string, type string, min_length int, n_enum int")


def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.json_rows(V.results(*_checked(_pages(spark, sf_dir), refs=list(DEFAULT_SET))))


def report_sarif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole result objects."""
    return O.sarif_rows(V.results(*_checked(_pages(spark, sf_dir), refs=list(DEFAULT_SET)))).select("file", "ord", "rule", "line")


def _got(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    content = R.json_block(title=F.when(F.col("k") % 2 == 0, F.col("nm")), n=F.when(F.col("k") % 3 == 0, F.col("k")))
    refs = ["title", "n"]
    return G.get(X.extract(_suppliers(spark, sf_dir).select(F.concat(F.col("k").cast("string"), F.lit(".md")).alias("file"), content.alias("content"))), refs), refs


def report_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text report, files without a set field hidden, and the JSON one."""
    got, refs = _got(spark, sf_dir)
    quiet = P.get_rows(got, refs, quiet=True).select("file", F.lit("pretty").alias("form"), "line")
    return quiet.unionAll(P.get_json_rows(got, refs).select("file", F.lit("json").alias("form"), "line"))


def own_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's own ``$schema``: a string, a list with repeats, null, an empty list, a number; under two kinds of trust."""
    shape = F.col("k") % 5
    own = F.when(shape == 0, F.lit('"google:okf:0.1"')).when(shape == 1, F.lit('["a.json","b.json","a.json"]')).when(shape == 2, F.lit("null")).when(shape == 3, F.lit("[]")).otherwise(F.lit("7"))
    content = F.concat(F.lit(';;;\n{"$schema":'), own, F.lit("}\n;;;\n"))
    rows = X.extract(_suppliers(spark, sf_dir).select(F.concat(F.col("k").cast("string"), F.lit(".md")).alias("file"), content.alias("content")))
    out = None
    for mode in ("any", "none"):
        found = S.resolve(rows, S.Rules(config=("c.json",), trust=S.Trust(mode)))
        part = found.select("file", F.lit(mode).alias("trust"), "source", F.array_join("schemas", ",").alias("schemas"), F.col("schema_error").isNotNull().alias("failed"))
        out = part if out is None else out.unionAll(part)
    return out


def synthetic_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that can't be read, or name a contract that can't be loaded, each as one violation."""
    shape = F.col("k") % 3
    content = F.when(shape == 0, F.lit("---\na: [1\n---\n")).when(shape == 1, F.lit(';;;\n{"$schema":"nowhere:at:all"}\n;;;\n')).otherwise(F.lit(';;;\n{"$schema":5}\n;;;\n'))
    rows = X.extract(_suppliers(spark, sf_dir).select(F.concat(F.col("k").cast("string"), F.lit(".md")).alias("file"), content.alias("content")))
    found = V.violations(S.resolve(rows, S.Rules()), Registry())
    return found.select("file", "ord", "schema", "instance_path", "keyword", "line")


class _Counted(FI.MockProvider):
    """The table provider, with the tokens that its answers took."""

    def propose(self, prompt: str, envelope: dict) -> dict:
        return super().propose(prompt, envelope) | {FI.USAGE: {"input": 10, "output": 3}}


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = S.resolve(X.extract(_pages(spark, sf_dir), keep=("content",)), S.Rules())
    return FI.fill(resolved, Registry(), _Counted({"type": ("page", 0.4)}), list(DEFAULT_SET))


def fill_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, tokens and cost of a run."""
    return FI.summary(_filled(spark, sf_dir), (3.0, 15.0)).select("files", "calls", "input_tokens", "output_tokens", F.round("cost", 9).alias("cost"))


def fill_github(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of required fields that weren't filled."""
    return FI.github_rows(_filled(spark, sf_dir))


def fill_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in pieces of at most 500 characters that, joined, are the text."""

    @F.pandas_udf("array<string>")
    def split(texts):
        return texts.map(lambda t: FI.split_body(t or "", 500))

    d = R.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("parts", split("text"))
    longest = F.array_max(F.transform("parts", F.char_length))
    return d.select("doc_id", (F.array_join("parts", "") == F.col("text")).alias("lossless"), (longest <= 500).alias("fits"), (F.size("parts") == 1).alias("single"))


def fill_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals of two parts of a text: the surer one, the earlier one of equals."""

    @F.pandas_udf("string")
    def merged(first, second):
        sets = ([{"x": {"value": v, "confidence": c / 10}} for v, c in zip("ab", pair)] for pair in zip(first, second))
        return first.__class__([FI.merge_proposals(list(s))["x"]["value"] for s in sets], index=first.index, dtype=object)

    s = _suppliers(spark, sf_dir)
    return s.select("k", merged(F.col("k") % 7, F.col("n").cast("long") % 7).alias("taken"))


def trusted_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local trust: built-in contracts and files inside of the root, no others."""
    shape = F.col("k") % 4
    own = F.when(shape == 0, "google:okf:0.1").when(shape == 1, "schemas/a.json").when(shape == 2, "schemas/../../b.json").otherwise("https://x.test/a.json")
    content = F.concat(F.lit(';;;\n{"$schema":"'), own, F.lit('"}\n;;;\n'))
    rows = X.extract(_suppliers(spark, sf_dir).select(F.concat(F.col("k").cast("string"), F.lit(".md")).alias("file"), content.alias("content")))
    found = S.resolve(rows, S.Rules(trust=S.Trust("local", root="/data/docs")))
    return found.select("file", "source", F.col("schema_error").isNotNull().alias("refused"))


def baseline_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries and prints of a baseline that lies in another folder than the run: file references and paths are told from there."""
    ref = F.when(F.col("k") % 2 == 0, "c.json").otherwise("google:okf:0.1")
    found = _suppliers(spark, sf_dir).select(F.concat(F.lit("x/../"), F.col("k").cast("string"), F.lit(".md")).alias("file"), ref.alias("schema"), F.lit("/a").alias("instance_path"), F.lit("type").alias("keyword"), F.lit(None).cast("string").alias("subject"))
    base = B.Base("/w/base", "/w/run/docs", "/w/run")
    return B.build(B.with_fingerprints(found, base, ["c.json", "google:okf:0.1"])).select("file", F.array_join("fingerprints", ",").alias("fingerprints"))


def canonical_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON with its keys in order, and whether two texts hold the same value."""

    @F.pandas_udf("string")
    def ordered(texts):
        return texts.map(lambda t: values.canonical(values.load(t)))

    @F.pandas_udf("boolean")
    def alike(a, b):
        return a.combine(b, lambda x, y: values.same(values.load(x), values.load(y)))

    k, n = F.col("k").cast("string"), F.col("n")
    text = F.concat(F.lit('{"b": '), k, F.lit(', "a": ['), n, F.lit(', {"z": 1, "y": null}]}'))
    other = F.concat(F.lit('{"a":['), n, F.lit(',{"y":null,"z":1}],"b":'), F.when(F.col("k") % 3 == 0, F.concat(k, F.lit(".5"))).otherwise(k), F.lit("}"))
    return _suppliers(spark, sf_dir).select("k", ordered(text).alias("canonical"), alike(text, other).alias("same"))


QUERIES = {
    "fill_usage": fill_usage,
    "fill_github": fill_github,
    "fill_chunks": fill_chunks,
    "fill_merged": fill_merged,
    "resolve_trust": trusted_contracts,
    "baseline_paths": baseline_paths,
    "canonical_values": canonical_values,
    "extract_odd_fences": odd_fences,
    "extract_html_meta": html_meta,
    "extract_dita_signs": dita_signs,
    "write_formats": written_formats,
    "infer_samples": samples,
    "infer_covered": covered,
    "infer_draft": drafted,
    "report_json": report_json,
    "report_sarif": report_sarif,
    "report_get": report_get,
    "resolve_own": own_contracts,
    "validate_synthetic": synthetic_errors,
}

_S = "s AS (SELECT s_suppkey AS k, s_name AS nm, s_nationkey AS n FROM supplier)"
_O = """o AS (SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS status, 'https://x.test/' || o_orderpriority AS link FROM orders),
  occ AS (SELECT k, 'day' AS key, '"' || day || '"' AS v FROM o UNION ALL SELECT k, 'stamp', '"' || day || 'T10:00:00Z"' FROM o UNION ALL SELECT k, 'link', '"' || link || '"' FROM o
    UNION ALL SELECT k, 'status', '"' || status || '"' FROM o UNION ALL SELECT k, 'rare', '"r' || k || '"' FROM o WHERE k % 50 = 0)"""
#: The violations of the default contracts: pages that aren't behind https have no type.
_ERRORS = """bare AS (SELECT 'docs/' || page_id || '.md' AS file, url NOT LIKE 'https://%' AS bad FROM pages)"""

ORACLES = {
    "fill_usage": "SELECT count(*) AS files, count(*) AS calls, 10 * count(*) AS input_tokens, 3 * count(*) AS output_tokens, round(count(*) * 75 / 1e6, 9) AS cost FROM pages",
    "fill_github": f"WITH {_ERRORS} SELECT file, '::error file=' || file || '::/type required field not filled: low-confidence' AS line FROM bare WHERE bad",
    "fill_chunks": "SELECT doc_id, true AS lossless, true AS fits, length(coalesce(text, '')) <= 500 AS single FROM documents",
    "fill_merged": f"WITH {_S} SELECT k, CASE WHEN n % 7 > k % 7 THEN 'b' ELSE 'a' END AS taken FROM s",
    "resolve_trust": f"WITH {_S} SELECT k || '.md' AS file, 'document' AS source, k % 4 >= 2 AS refused FROM s",
    "baseline_paths": f"""WITH {_S} SELECT '../run/docs/' || k || '.md' AS file, left(sha256(CASE WHEN k % 2 = 0 THEN '../run/c.json' ELSE 'google:okf:0.1' END || chr(0) || '/a' || chr(0) || 'type' || chr(0)), 16) AS fingerprints FROM s""",
    "canonical_values": f"""WITH {_S} SELECT k, '{{"a":[' || n || ',{{"y":null,"z":1}}],"b":' || k || '}}' AS canonical, k % 3 <> 0 AS same FROM s""",
    "extract_odd_fences": f"""WITH {_S} SELECT k || CASE k % 5 WHEN 0 THEN '.adoc' WHEN 1 THEN '.rst' WHEN 2 THEN '.md' WHEN 3 THEN '.mdx' ELSE '.asciidoc' END AS file,
        CASE k % 5 WHEN 1 THEN 'rst' WHEN 2 THEN 'markdown' WHEN 3 THEN 'mdx' ELSE 'asciidoc' END AS format, k % 5 <> 3 AS present,
        CASE WHEN k % 5 <> 3 THEN '"' || nm || '"' END AS title, CASE k % 5 WHEN 4 THEN 1 WHEN 3 THEN NULL ELSE 2 END AS title_line,
        CASE k % 5 WHEN 3 THEN NULL WHEN 4 THEN 'false' ELSE n::VARCHAR END AS nation, CASE k % 5 WHEN 0 THEN 3 WHEN 1 THEN 5 WHEN 2 THEN 4 WHEN 3 THEN NULL ELSE 2 END AS nation_line,
        CASE WHEN k % 5 = 4 THEN 'true' END AS draft FROM s""",
    "extract_html_meta": f"""WITH {_S} SELECT k || '.html' AS file, CASE WHEN k % 2 = 0 THEN '"' || nm || ' & more"' ELSE '"Page <' || k || '>"' END AS title, CASE WHEN k % 2 = 0 THEN 9 ELSE 2 END AS title_line,
        n::VARCHAR AS nation, 4 AS nation_line, 7 AS nation_col, 'true' AS flag, 5 AS flag_line, 1 AS flag_col, '""' AS empty, NULL::VARCHAR AS lost FROM s""",
    "extract_dita_signs": f"""WITH {_S} SELECT k || CASE k % 6 WHEN 3 THEN '.dita' WHEN 5 THEN '.ditamap' ELSE '.xml' END AS file, 'xml' AS format, true AS present, '"a"' AS id, CASE WHEN k % 6 <> 4 THEN n::VARCHAR END AS nation FROM s""",
    "write_formats": f"""WITH {_S} SELECT k || '.toml.mdx' AS file, '+++|nation = "N' || n || '"|added = ' || k || '||[t]|x = 1|+++|Text.|' AS content, false AS refused FROM s
        UNION ALL SELECT k || '.json.md', ';;;|{{|  "nation": "N' || n || '",|  "added": ' || k || '|}}|;;;|Text.|', false FROM s
        UNION ALL SELECT k || '.adoc', '---|nation: N' || n || '|added: ' || k || '|---|= T|', false FROM s
        UNION ALL SELECT k || '.bare.adoc', '= T|:nation: ' || n || '|', true FROM s
        UNION ALL SELECT k || '.html', '<html><head>|<meta name="added" content="' || k || '">|<meta name="nation" content="N' || n || '">|</head></html>|', false FROM s
        UNION ALL SELECT k || '.bare.html', '<p>x</p>|', true FROM s
        UNION ALL SELECT k || '.xml', '<?xml version="1.0"?>|<doc nation="N' || n || '" added="' || k || '"><a/></doc>|', false FROM s
        UNION ALL SELECT k || '.dita', '<topic id="t">|<title>T</title>|<prolog><metadata>|<othermeta name="nation" content="N' || n || '"/>|</metadata></prolog>|</topic>|', false FROM s""",
    "infer_samples": f"""WITH {_O}, byv AS (SELECT key, v, count(*) AS c, min(k) AS f FROM occ GROUP BY ALL)
        SELECT key, sum(c)::BIGINT AS present, first(v ORDER BY c DESC, f) AS sample, CASE key WHEN 'day' THEN 'date' WHEN 'stamp' THEN CASE WHEN count(*) <= 1000 THEN 'date-time' END WHEN 'link' THEN 'uri' END AS format, bool_or(v = '""') AS has_empty
        FROM byv GROUP BY key""".replace("WHEN 'day' THEN 'date'", "WHEN 'day' THEN CASE WHEN count(*) <= 1000 THEN 'date' END"),
    "infer_covered": "SELECT * FROM (VALUES (1, 'day'), (2, 'link'), (3, 'stamp'), (4, 'status')) AS t(place, key)",
    "infer_draft": f"""WITH {_O}, d AS (SELECT key, count(*) AS present, count(DISTINCT v) AS n, bool_or(v = '""') AS empty FROM occ GROUP BY key)
        SELECT row_number() OVER (ORDER BY key)::INT AS place, key, 'string' AS type, CASE WHEN NOT (n <= 20 AND n <= 0.05 * present) AND NOT empty THEN 1 END AS min_length, CASE WHEN n <= 20 AND n <= 0.05 * present THEN n ELSE 0 END::INT AS n_enum FROM d""",
    "report_json": f"""WITH {_ERRORS} SELECT file, '{{"file":"' || file || '","format":"markdown","ok":' || (NOT bad)::VARCHAR || ',"schemas":["google:okf:0.1","passo-uno:seven-action:1.0"],"errors":[' ||
        CASE WHEN bad THEN '{{"schema":"google:okf:0.1","instancePath":"","message":"must have required property ''type''","keyword":"required","subject":"type","line":1}}' ELSE '' END || ']}}' AS line FROM bare""",
    "report_sarif": f"""WITH {_ERRORS}, p AS (SELECT left(sha256('google:okf:0.1' || chr(0) || '' || chr(0) || 'required' || chr(0) || 'type'), 16) AS print)
        SELECT file, 0 AS ord, 'google:okf:0.1/required' AS rule, '{{"ruleId":"google:okf:0.1/required","level":"error","message":{{"text":"(root) must have required property ''type''"}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || file ||
        '"}},"region":{{"startLine":1}}}}}}],"partialFingerprints":{{"metaloom/v1":"' || print || '"}}}}' AS line FROM bare, p WHERE bad""",
    "report_get": f"""WITH {_S}, g AS (SELECT k || '.md' AS file, CASE WHEN k % 2 = 0 THEN nm END AS title, CASE WHEN k % 3 = 0 THEN k END AS n FROM s)
        SELECT file, 'pretty' AS form, file || chr(10) || '  title: ' || coalesce(title, '(unset)') || chr(10) || '  n: ' || coalesce(n::VARCHAR, '(unset)') AS line FROM g WHERE title IS NOT NULL OR n IS NOT NULL
        UNION ALL SELECT file, 'json', '{{"file":"' || file || '","present":true,"fields":{{' || concat_ws(',', '"title":"' || title || '"', '"n":' || n) || '}}}}' FROM g""",
    "resolve_own": f"""WITH {_S}, m AS (SELECT unnest(['any', 'none']) AS trust) SELECT k || '.md' AS file, trust, CASE WHEN trust = 'any' AND k % 5 < 2 THEN 'document' ELSE 'config' END AS source,
        CASE WHEN trust = 'any' AND k % 5 = 0 THEN 'google:okf:0.1' WHEN trust = 'any' AND k % 5 = 1 THEN 'a.json,b.json' ELSE 'c.json' END AS schemas, trust = 'any' AND k % 5 = 4 AS failed FROM s, m""",
    "validate_synthetic": f"""WITH {_S} SELECT k || '.md' AS file, 0 AS ord, '(parse)' AS schema, '' AS instance_path, CASE WHEN k % 3 = 0 THEN 'parse' ELSE 'schema' END AS keyword, NULL::INT AS line FROM s""",
}
