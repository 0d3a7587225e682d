"""Resolution, validation, baseline, reports."""

import json
import os
import subprocess
import xml.etree.ElementTree as ET

import pytest

from metaloom import api
from metaloom.cli import main, suggest
from metaloom.operators import baseline as B
from metaloom.operators import extract as X
from metaloom.operators import resolve as S
from metaloom.sources import config as C
from metaloom.sources import files

GOOD = "---\ntype: guide\ntitle: T\n---\n"
KEYWORDS = {
    "type": "object",
    "additionalProperties": False,
    "required": ["title"],
    "properties": {"title": {"type": "string"}, "slug": {"type": "string", "minLength": 5, "pattern": "^[a-z-]+$"}, "timestamp": {"type": "string", "format": "date-time"}},
}


@pytest.mark.parametrize(
    ("path", "keyword", "subject", "print_"),
    [("/timestamp", "format", "date-time", "0161935082eddfca"), ("/slug", "pattern", None, "4ebdaf09960970c9"), ("/slug", "minLength", None, "96b62ef2a7edd519")],
)
def test_fingerprints_known(path, keyword, subject, print_):
    assert B.fingerprint_text("test/fixtures/baseline/keywords.schema.json", path, keyword, subject) == print_


def test_fingerprint_column(spark):
    from pyspark.sql import functions as F

    got = spark.range(1).select(B.fingerprint(F.lit("google:okf:0.1"), F.lit("/timestamp"), F.lit("format"), F.lit("date-time"))).first()[0]
    assert got == "a0e67da36246d5d9"


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [("docs/**", ["docs/a.md", "docs/x/.b.md"], ["doc/a.md"]), ("**/*.md", ["a.md", "x/y/b.md"], ["a.mdx"]), ("a/*.{md,rst}", ["a/b.md", "a/.c.rst"], ["a/b/c.md"]), ("x?[ab].md", ["x1a.md"], ["x1c.md", "x/a.md"])],
)
def test_globs(glob, yes, no):
    import re

    assert all(re.search(S.glob_regex(glob), x) for x in yes) and not any(re.search(S.glob_regex(glob), x) for x in no)


def resolved(spark, blocks, rules):
    rows = [(f"d/{i}.md", f"---\n{b}\n---\n") for i, b in enumerate(blocks)]
    found = S.resolve(X.extract(spark.createDataFrame(rows, "file string, content string")), rules).orderBy("file").collect()
    return [(r["source"], list(r["schemas"]), r["schema_error"]) for r in found]


def test_precedence(spark):
    blocks = ["$schema: a:b:1", "$schema: [x.json, x.json, y.json]", "$schema: null", "$schema: 3", "$schema: []", "t: 1"]
    got = resolved(spark, blocks, S.Rules())
    assert got[0][:2] == ("document", ["a:b:1"]) and got[1][:2] == ("document", ["x.json", "y.json"])
    assert got[2][0] == got[4][0] == got[5][0] == "default" and got[3][2] is not None and got[2][2] is None
    assert {s for s, *_ in resolved(spark, blocks, S.Rules(cli=("z",)))} == {"cli"}
    over = S.Rules(overrides=(S.Override(("d/0*",), ("o",)), S.Override(("d/**",), ("p", "p"))), config=("c",))
    got = resolved(spark, ["t: 1", "t: 1"], over)
    assert got[0][:2] == ("override", ["o"]) and got[1][:2] == ("override", ["p"])


def test_trust(spark, tmp_path):
    blocks = ["$schema: https://evil.example/x.json", "$schema: google:okf:0.1", "$schema: ../../up.json"]
    got = resolved(spark, blocks, S.Rules(trust=S.Trust("local", root=str(tmp_path))))
    assert got[0][2] and not got[1][2] and got[2][2]
    got = resolved(spark, blocks, S.Rules(trust=S.Trust("none")))
    assert {s for s, *_ in got} == {"default"}
    hosts = S.Trust("any", hosts=("Good.example:8080",))
    assert hosts.refusal("https://good.example:8080/a") is None and hosts.refusal("https://other.example/a")


@pytest.fixture
def site(tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "clean.md").write_text("---\ntitle: a\nslug: abcde\n---\n")
    (docs / "one.md").write_text("---\ntitle: a\ntimestamp: soon\n---\n")
    (docs / "two.md").write_text("---\ntitle: a\nslug: A1\n---\n")
    (tmp_path / "k.json").write_text(json.dumps(KEYWORDS))
    return tmp_path


def lines(capsys):
    return capsys.readouterr().out


def test_validate_and_ratchet(spark, site, capsys):
    run = lambda *more: main(["validate", "docs", "-s", "k.json", *more], spark, str(site))
    assert run() == 1
    text = lines(capsys)
    assert "3 files checked, 1 passed, 2 failed, 3 errors" in text and "(line 3)" in text and "/slug" in text
    assert run("--baseline", "base.json") == 2
    capsys.readouterr()
    assert run("--baseline", "base.json", "--write-baseline") == 0
    assert "3 findings recorded (+3 new, -0 no longer occur)" in lines(capsys)
    assert B.read(str(site / "base.json")).keys() == {"docs/one.md", "docs/two.md"}
    assert run("--baseline", "base.json") == 0
    assert "3 baselined findings" in lines(capsys)
    (site / "docs/one.md").write_text("---\ntitle: a\n---\n")
    (site / "docs/two.md").write_text("---\ntitle: a\nslug: A1\nmore: 1\n---\n")
    assert run("--baseline", "base.json") == 1
    text = lines(capsys)
    assert "3 baselined findings, 1 no longer occurs" in text and "1 error" in text and "must NOT have additional property 'more'" in text


def test_report_forms(spark, site, capsys):
    run = lambda form: main(["validate", "docs", "-s", "k.json", "--format", form], spark, str(site))
    assert run("json") == 1
    body = json.loads(lines(capsys))
    assert body["summary"]["errors"] == 3 and [r["file"] for r in body["results"]] == ["docs/clean.md", "docs/one.md", "docs/two.md"]
    assert body["results"][1]["errors"][0]["keyword"] == "format" and body["results"][0]["errors"] == []
    assert run("github") == 1
    assert lines(capsys).splitlines()[0] == '::error file=docs/one.md,line=3::[k.json] /timestamp must match format "date-time"'
    assert run("junit") == 1
    suite = ET.fromstring(lines(capsys))
    assert suite.get("tests") == "3" and len(suite.findall(".//failure")) == 3 and suite.get("failures") == "2"
    assert run("sarif") == 1
    log = json.loads(lines(capsys))
    assert log["version"] == "2.1.0" and len(log["runs"][0]["results"]) == 3
    first = log["runs"][0]["results"][0]
    assert first["locations"][0]["physicalLocation"]["region"]["startLine"] == 3 and len(log["runs"][0]["tool"]["driver"]["rules"]) == 3


def test_parse_errors_and_broken_document_schema(spark, site, capsys):
    (site / "docs/bad.md").write_text('---\na: "x\n---\n')
    (site / "docs/own.md").write_text("---\n$schema: missing.json\n---\n")
    assert main(["validate", "docs", "--format", "json"], spark, str(site)) == 1
    found = {r["file"]: r for r in json.loads(lines(capsys))["results"]}
    assert found["docs/bad.md"]["errors"][0]["keyword"] == "parse" and found["docs/own.md"]["errors"][0]["keyword"] == "schema"
    assert main(["validate", "docs", "-s", "missing.json"], spark, str(site)) == 2


def test_get_and_suggestions(spark, site, capsys):
    assert main(["get", "title,slug,/nope", "docs", "--quiet"], spark, str(site)) == 0
    text = lines(capsys)
    assert "docs/two.md\n  title: a\n  slug: A1\n  /nope: (unset)" in text
    assert main(["get", "slug", "docs", "--format", "json"], spark, str(site)) == 0
    assert json.loads(lines(capsys).splitlines()[1]) == {"file": "docs/one.md", "present": True, "fields": {}}
    assert suggest("validat") == "validate" and suggest("zzz") is None


def test_files(tmp_path):
    for name in ("a.md", "b.txt", "sub/c.MD", "sub/.d.md", "node_modules/e.md", "skip/f.md"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("x")
    base = str(tmp_path)
    assert files.find(["."], ["md"], base, gitignore=False).all == ["a.md", "skip/f.md", "sub/c.MD"]
    assert files.find([".", "b.txt"], [".md"], base, ["skip/**"], gitignore=False).all == ["a.md", "b.txt", "sub/c.MD"]
    assert files.find(["sub/*.MD"], ["md"], base, gitignore=False).all == ["sub/c.MD"]
    with pytest.raises(files.InputError, match="nope, gone"):
        files.find(["nope", "gone"], ["md"], base)
    with pytest.raises(files.InputError, match="no files match"):
        files.find(["*.zip"], ["md"], base)
    subprocess.run(["git", "init", "-q"], cwd=base, check=True)
    (tmp_path / ".gitignore").write_text("skip/\n")
    found = files.find([".", "skip/f.md"], ["md"], base)
    assert found.all == ["a.md", "skip/f.md", "sub/c.MD"] and found.gitignore_skipped == 0
    assert files.find(["."], ["md"], base).gitignore_skipped == 1


def test_config(tmp_path):
    text = "paths: [docs]\nexclude: ['x/**']\nschemas:\n  - a.json\n  - ref: b.json\n    integrity: sha256-" + "0" * 64 + "\noverrides:\n  - files: ['d/**']\n    schemas: [c.json]\nschemaTrust: {documentRefs: local, hosts: [h]}\nfill: {confidence: 0.5, concurrency: 4}\n"
    got = C.parse(text)
    assert got.schemas == ["a.json", "b.json"] and "b.json" in got.pins and got.trust_mode == "local" and got.fill["concurrency"] == 4
    for bad in ("paths: x", "nope: 1", "schemaTrust: {documentRefs: x}", "fill: {concurrency: 65}", "schemas: [{ref: 'https://x', integrity: sha256-1}]", "overrides: [{files: [a], schemas: [b], more: 1}]", "baseline: 3"):
        with pytest.raises(C.ConfigError):
            C.parse(bad)
    (tmp_path / ".git").mkdir()
    (tmp_path / "metaloom.config.yaml").write_text("paths: [docs]\n")
    inner = tmp_path / "a" / "b"
    inner.mkdir(parents=True)
    assert C.load(str(inner)).paths == ["docs"] and C.load(str(inner)).rebased("x.json", str(inner)) == os.path.join(str(tmp_path), "x.json")


def test_standard_input(spark, tmp_path):
    run = api.prepare(spark, ["-"], str(tmp_path), as_format="markdown", stdin=GOOD)
    assert api.validate(run).summary["passed"] == 1


def test_streaming_agrees(spark, tmp_path):
    from metaloom import streaming
    from metaloom.sources.registry import Registry

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text(GOOD)
    (tmp_path / "in/b.md").write_text("---\ntitle: T\n---\n")
    stream = streaming.documents(spark, str(tmp_path / "in"))
    query = streaming.validate_to(stream, S.Rules(), Registry(), ["google:okf:0.1", "passo-uno:seven-action:1.0"], str(tmp_path / "out"), str(tmp_path / "check"))
    query.processAllAvailable()
    query.stop()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(os.path.basename(r["file"]), r["keyword"], r["subject"]) for r in got] == [("b.md", "required", "type")]


def test_field_or_path(tmp_path):
    from metaloom.cli import get_inputs

    (tmp_path / "docs").mkdir()
    assert get_inputs("title,x", ["docs"], None, str(tmp_path)) == (["title", "x"], ["docs"])
    assert get_inputs("docs", [], "title", str(tmp_path)) == (["title"], ["docs"])
    for words in (("docs", []), (None, []), ("a/*.md", [])):
        with pytest.raises(ValueError):
            get_inputs(*words, None, str(tmp_path))


def test_unknown_formats_end_the_run(spark, tmp_path):
    (tmp_path / "a.bin").write_text("x")
    for verb in (["validate", "a.bin"], ["get", "title", "a.bin"], ["schemas", "infer", "a.bin"]):
        assert main(verb, spark, str(tmp_path)) == 2
