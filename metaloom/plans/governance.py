"""Contract resolution, validation and baseline queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloom.operators import baseline as B
from metaloom.operators import extract as X
from metaloom.operators import resolve as S
from metaloom.operators import validate as V
from metaloom.sources.builtins import DEFAULT_SET
from metaloom.sources.registry import Registry

from . import rendering as R


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as JSON front matter; only those behind https have a type."""
    kind = F.when(F.col("url").startswith("https://"), F.lit("page"))
    content = R.json_block(title=F.concat(F.lit("Page "), F.col("page_id").cast("string")), resource=F.col("url"), type=kind)
    return R.table(spark, sf_dir, "pages").select(F.concat(F.lit("docs/"), F.col("page_id").cast("string"), F.lit(".md")).alias("file"), content.alias("content"))


def _checked(documents: DataFrame, rules: S.Rules = S.Rules(), registry: Registry | None = None, refs: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    resolved = S.resolve(X.extract(documents), rules)
    registry = registry or Registry()
    return resolved, V.violations(resolved, registry, [(r, True) for r in refs] if refs is not None else None)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan, extract, resolve, validate, fingerprint, count: violations of the default contracts."""
    _, found = _checked(_pages(spark, sf_dir), refs=list(DEFAULT_SET))
    return B.with_fingerprints(found).groupBy("schema", "keyword", "subject", "fingerprint").agg(F.count("*").alias("n"))


def violations_compiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same contracts as column expressions: no Python between extraction and count."""
    docs = _pages(spark, sf_dir)
    rows = docs.select("file", F.to_json(X.json_front_matter(F.col("content"))).alias("data_json"), F.lit(None).cast("string").alias("error"))
    found = V.fast_violations(S.resolve(rows, S.Rules()), Registry(), list(DEFAULT_SET))
    return found.groupBy("schema", "instance_path", "keyword", "message").agg(F.count("*").alias("n"))


CUSTOMER_CONTRACT = {
    "type": "object",
    "required": ["name", "segment"],
    "additionalProperties": False,
    "properties": {
        "name": {"type": "string", "minLength": 1, "pattern": "^Customer#[0-9]+$"},
        "segment": {"enum": ["BUILDING", "MACHINERY", "HOUSEHOLD"]},
        "balance": {"type": "number", "minimum": 0},
        "nation": {"type": "integer", "maximum": 20},
    },
}


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"name": R.quoted(F.col("c_name")), "segment": R.quoted(F.col("c_mktsegment")), "balance": F.col("c_acctbal").cast("string"), "nation": F.col("c_nationkey").cast("string")}
    return R.table(spark, sf_dir, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit(".md")).alias("file"), R.yaml(**fields).alias("content"))


def keyword_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = Registry(extra={"customer.json": CUSTOMER_CONTRACT})
    _, found = _checked(_customers(spark, sf_dir), S.Rules(cli=("customer.json",)), registry, ["customer.json"])
    return found.select("file", "instance_path", "keyword", "message", "line")


def keyword_violations_compiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = Registry(extra={"customer.json": CUSTOMER_CONTRACT})
    c = R.table(spark, sf_dir, "customer")
    data = R.json_text(name=F.col("c_name"), segment=F.col("c_mktsegment"), balance=F.col("c_acctbal"), nation=F.col("c_nationkey"))
    rows = c.select(F.concat(F.col("c_custkey").cast("string"), F.lit(".md")).alias("file"), data.alias("data_json"), F.lit(None).cast("string").alias("error"))
    found = V.fast_violations(S.resolve(rows, S.Rules(cli=("customer.json",))), registry, ["customer.json"])
    return found.select("file", "instance_path", "keyword", "message")


def resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's contracts come from: its own, an override by path, or the default."""
    own = F.when(F.col("n_nationkey") % 5 == 0, F.lit("diataxis:diataxis:1.0"))
    content = R.yaml(title=R.quoted(F.col("n_name")), **{"$schema": own})
    docs = R.table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/"), F.col("n_nationkey").cast("string"), F.lit(".md")).alias("file"), content.alias("content"))
    rules = S.Rules(overrides=(S.Override(("r{1,2}/**",), ("tgdp:templates:1.0",)), S.Override(("r2/*.md", "r3/*"), ("google:okf:0.1",))))
    found = S.resolve(X.extract(docs), rules)
    return found.select("file", "source", F.concat_ws(",", "schemas").alias("schemas"))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved, found = _checked(_pages(spark, sf_dir), refs=list(DEFAULT_SET))
    return V.summary(V.results(resolved, found))


def _printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = Registry(extra={"customer.json": CUSTOMER_CONTRACT})
    _, found = _checked(_customers(spark, sf_dir), S.Rules(cli=("customer.json",)), registry, ["customer.json"])
    # read several times below: extracted and checked once
    return B.with_fingerprints(found).persist()


def _recorded(printed: DataFrame) -> DataFrame:
    """A baseline of an earlier run: all but balance violations, and one that has gone since."""
    old = printed.where("instance_path <> '/balance'").select(F.col("entry").alias("file"), "fingerprint").distinct()
    gone = printed.select(F.col("entry").alias("file"), F.lit("0" * 16).alias("fingerprint")).distinct()
    return old.union(gone)


def baseline_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    printed = _printed(spark, sf_dir)
    return B.apply(printed, printed.select("entry"), _recorded(printed)).counts


def baseline_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    printed = _printed(spark, sf_dir)
    return B.apply(printed, printed.select("entry"), _recorded(printed)).fresh.select("file", "instance_path", "keyword", "fingerprint")


def baseline_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.build(_printed(spark, sf_dir)).select("file", F.concat_ws(",", "fingerprints").alias("fingerprints"))


def baseline_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    printed = _printed(spark, sf_dir)
    after = printed.select(F.col("entry").alias("file"), "fingerprint")
    return B.diff(_recorded(printed), after).groupBy("change").agg(F.count("*").alias("n"))


QUERIES = {
    "validate_default_set": flagship,
    "validate_default_set_compiled": violations_compiled,
    "validate_keywords": keyword_violations,
    "validate_keywords_compiled": keyword_violations_compiled,
    "resolve_contracts": resolution,
    "run_summary": run_summary,
    "baseline_counts": baseline_counts,
    "baseline_fresh": baseline_fresh,
    "baseline_build": baseline_build,
    "baseline_diff": baseline_diff,
}

_FOUND = """found AS (
  SELECT c_custkey, '/segment' AS path, 'enum' AS keyword, NULL AS subject, 'must be equal to one of the allowed values' AS message, 3 AS line FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')
  UNION ALL SELECT c_custkey, '/balance', 'minimum', NULL, 'must be >= 0', 4 FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT c_custkey, '/nation', 'maximum', NULL, 'must be <= 20', 5 FROM customer WHERE c_nationkey > 20
  UNION ALL SELECT c_custkey, '/name', 'pattern', NULL, 'must match pattern "^Customer#[0-9]+$"', 2 FROM customer WHERE NOT regexp_matches(c_name, '^Customer#[0-9]+$')
), printed AS (
  SELECT *, c_custkey::VARCHAR || '.md' AS file, left(sha256('customer.json' || chr(0) || path || chr(0) || keyword || chr(0) || coalesce(subject, '')), 16) AS fingerprint FROM found
), recorded AS (SELECT DISTINCT file, fingerprint FROM printed WHERE path <> '/balance' UNION SELECT DISTINCT file, repeat('0', 16) FROM printed)"""

ORACLES = {
    "validate_default_set": """SELECT 'google:okf:0.1' AS schema, 'required' AS keyword, 'type' AS subject,
        left(sha256('google:okf:0.1' || chr(0) || '' || chr(0) || 'required' || chr(0) || 'type'), 16) AS fingerprint, count(*) AS n FROM pages WHERE url NOT LIKE 'https://%' HAVING count(*) > 0""",
    "validate_default_set_compiled": """SELECT 'google:okf:0.1' AS schema, '' AS instance_path, 'required' AS keyword, 'must have required property ''type''' AS message, count(*) AS n
        FROM pages WHERE url NOT LIKE 'https://%' HAVING count(*) > 0""",
    "validate_keywords": f"WITH {_FOUND} SELECT file, path AS instance_path, keyword, message, line FROM printed",
    "validate_keywords_compiled": f"WITH {_FOUND} SELECT file, path AS instance_path, keyword, message FROM printed",
    "resolve_contracts": """SELECT 'r' || n_regionkey || '/' || n_nationkey || '.md' AS file,
        CASE WHEN n_nationkey % 5 = 0 THEN 'document' WHEN n_regionkey IN (1, 2, 3) THEN 'override' ELSE 'default' END AS source,
        CASE WHEN n_nationkey % 5 = 0 THEN 'diataxis:diataxis:1.0' WHEN n_regionkey IN (1, 2) THEN 'tgdp:templates:1.0' WHEN n_regionkey = 3 THEN 'google:okf:0.1'
        ELSE 'google:okf:0.1,passo-uno:seven-action:1.0' END AS schemas FROM nation""",
    "run_summary": """SELECT count(*) AS files, count(*) FILTER (url LIKE 'https://%') AS passed, count(*) FILTER (url NOT LIKE 'https://%') AS failed,
        (count(*) FILTER (url NOT LIKE 'https://%'))::BIGINT AS errors FROM pages""",
    "baseline_counts": f"""WITH {_FOUND} SELECT (SELECT count(*) FROM recorded) AS recorded,
        (SELECT count(*) FROM printed p WHERE EXISTS (SELECT 1 FROM recorded r WHERE r.file = p.file AND r.fingerprint = p.fingerprint)) AS suppressed,
        (SELECT count(*) FROM recorded r WHERE NOT EXISTS (SELECT 1 FROM printed p WHERE r.file = p.file AND r.fingerprint = p.fingerprint)) AS stale""",
    "baseline_fresh": f"WITH {_FOUND} SELECT file, path AS instance_path, keyword, fingerprint FROM printed WHERE path = '/balance'",
    "baseline_build": f"WITH {_FOUND} SELECT file, string_agg(DISTINCT fingerprint, ',' ORDER BY fingerprint) AS fingerprints FROM printed GROUP BY file",
    "baseline_diff": f"""WITH {_FOUND}, a AS (SELECT DISTINCT file, fingerprint FROM printed)
        SELECT 'added' AS change, count(*) AS n FROM (SELECT * FROM a EXCEPT SELECT * FROM recorded) HAVING count(*) > 0
        UNION ALL SELECT 'removed', count(*) FROM (SELECT * FROM recorded EXCEPT SELECT * FROM a) HAVING count(*) > 0""",
}
