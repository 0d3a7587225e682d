"""Inference, fill and writers."""

import json
import sys

import pytest

from metaloom import api
from metaloom.cli import main
from metaloom.operators import extract as X
from metaloom.operators import extractors as E
from metaloom.operators import fill as FI
from metaloom.operators import infer as I
from metaloom.operators import writers as W


def profile(spark, objects):
    rows = [(f"{i}.md", f";;;\n{json.dumps(o)}\n;;;\n" if o is not None else "bare", i) for i, o in enumerate(objects)]
    found = I.occurrences(X.extract(spark.createDataFrame(rows, "file string, content string, file_ord long"), keep=("file_ord",)))
    return found, {r["key"]: r for r in I.profile(found, len(rows)).collect()}


def test_coverage_and_outliers(spark):
    base = {"type": "guide", "title": "T"}
    objects = [{**base, "title": f"T{i}", "owner": "a"} for i in range(4)] + [{**base, "title": "U", "owner": 7, "tags": ["x"]}, {**base, "title": "V", "tags": []}, {**base, "title": "W", "lastReviewed": "2024-01-02"}, None]
    found, got = profile(spark, objects)
    assert {k: round(r["coverage"], 1) for k, r in got.items()} == {"type": 87.5, "title": 87.5, "owner": 62.5, "tags": 25.0, "lastReviewed": 12.5}
    assert got["owner"]["type"] == "string" and got["lastReviewed"]["format"] == "date"
    assert [(r["key"], r["file"], r["value"]) for r in I.outliers(found).collect()] == [("owner", "4.md", "7")]
    draft = I.draft(I.profile(found, 8))
    assert list(draft["properties"]) == sorted(draft["properties"]) and "required" not in draft and draft["properties"]["title"] == {"type": "string", "minLength": 1}


def test_occurrences_of_documents_in_one_worker(spark):
    texts = ["---\na: 1.0\nb: [x, {c: ~}]\nd: .nan\n---\n", '+++\nday = 2024-05-01\nt = "é"\n+++\n', "---\na: [\n---\n", "bare", None, "---\n---\n", ";;;\n{}\n;;;\n"]
    rows = [(f"{i}.{'md' if i % 5 else 'mdx'}", texts[i % len(texts)], i) for i in range(3 * X.SLICE)] + [("x.bin", texts[0], -1)]
    documents = spark.createDataFrame(rows, "file string, content string, file_ord long").coalesce(1)
    one, two = I.occurrences_of_documents(documents), I.occurrences(X.extract(documents, keep=("file_ord",)))
    assert one.schema == two.schema and sorted(one.collect()) == sorted(two.collect())
    assert {(r["key"], r["type"], r["value"]) for r in one.collect()} == {("a", "number", "1"), ("b", "array", '["x",{"c":null}]'), ("d", "null", "null"), ("day", "string", '"2024-05-01"'), ("t", "string", '"é"')}
    assert [r["file_ord"] for r in one.where("key = 't'").collect()] == [i for i in range(len(rows) - 1) if i % len(texts) == 1]


@pytest.mark.parametrize("query", ["infer_profile", "infer_outliers"])
def test_inference_has_one_python_step(spark, query):
    from metaloom.plans import profiling

    plan = profiling.QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan


def test_slices_hold_few_rows():
    import pyarrow as pa

    batch = pa.record_batch({"n": list(range(2 * X.SLICE + 1))})
    pieces = list(X.slices(iter([batch, batch.slice(0, 0)])))
    assert [p.num_rows for p in pieces] == [X.SLICE, X.SLICE, 1] and pa.Table.from_batches(pieces).column("n").to_pylist() == list(range(2 * X.SLICE + 1))


@pytest.mark.parametrize(("distinct", "total", "enum"), [(7, 140, True), (30, 30, False), (7, 10, False), (5, 99, False), (5, 100, True), (21, 600, False)])
def test_enum_thresholds(spark, distinct, total, enum):
    _, got = profile(spark, [{"k": f"v{i % distinct}"} for i in range(total)])
    assert bool(got["k"]["enum"]) == enum


def test_many_distinct_values_are_capped(spark):
    _, got = profile(spark, [{"k": f"v{i}"} for i in range(1200)])
    assert (got["k"]["distinct"], got["k"]["capped"], got["k"]["format"]) == (1000, True, None)


def test_ties_and_samples(spark):
    _, got = profile(spark, [{"k": "b"}, {"k": "a"}, {"k": 1}, {"k": 2}, {"e": ""}])
    assert got["k"]["type"] == "number" and got["k"]["sample"] == "1" and got["e"]["has_empty"]


def test_infer_command(spark, tmp_path, capsys):
    for i in range(3):
        (tmp_path / f"{i}.md").write_text(f"---\ntype: a\nn: {i}\n---\n")
    (tmp_path / "x.md").write_text("none")
    (tmp_path / "bad.md").write_text("---\n- 1\n---\n")
    assert main(["schemas", "infer", ".", "--out", "draft.json"], spark, str(tmp_path)) == 0
    text = capsys.readouterr().out
    assert "5 files scanned · 1 with no metadata block · 1 unreadable" in text and "60.0%" in text
    assert json.loads((tmp_path / "draft.json").read_text())["properties"]["n"] == {"type": "number"}
    assert main(["schemas", "infer", ".", "--out", "draft.json"], spark, str(tmp_path)) == 2


YAML = '---\n# head\ntitle: "A"  # note\ntags: [a, b]\nlist:\n  - x\n  - y\n\n# tail\nz: 1\n---\nbody\n'


def test_yaml_edits_keep_the_rest():
    out = W.apply("markdown", YAML, {"title": "B: c", "tags": ["q"], "new": {"a": 1}})
    assert out == '---\n# head\ntitle: "B: c"  # note\ntags: [q]\nlist:\n  - x\n  - y\n\n# tail\nz: 1\nnew:\n  a: 1\n---\nbody\n'
    assert W.apply("markdown", YAML, {}) == YAML


@pytest.mark.parametrize("value", ["yes", "1", "a: b", "- x", "", " pad ", "two\nlines", "#no", "null", 1.5, True, None, ["a, b", 1], {"k": ["v"]}, "it's", 'say "x"', "é", "@at", "[x]", "a #b"])
@pytest.mark.parametrize("block", ["---\nk: old\n---\n", "---\nk: 'old'\n---\n", "---\nk:\n  - a\nafter: 1\n---\n", "---\nk: [a]\n---\n", "---\n---\n", "", "---\nk: |\n  text\n  more\nafter: 1\n---\n", "---\n{k: 1}\n---\n"])
def test_yaml_values_read_back(block, value):
    out = W.apply("markdown", block + "body\n", {"k": value})
    assert E.EXTRACTORS["markdown"].extract(out).data["k"] == value
    assert W.apply("markdown", out, {"k": value}).endswith("body\n")


def test_toml_edits():
    text = '+++\r\n# c\r\ntitle = "a" # n\r\narr = [\r\n  1, # ]\r\n  2\r\n]\r\nd = 2024-01-01\r\n[meta]\r\ntitle = "in"\r\n+++\r\n'
    out = W.apply("markdown", text, {"title": "b", "k": [1, "x"]})
    assert 'title = "b" # n\r\n' in out and 'k = [1, "x"]\r\n[meta]' in out and "arr = [\r\n  1, # ]\r\n  2\r\n]" in out and "\n" not in out.replace("\r\n", "")
    with pytest.raises(W.WriteError):
        W.apply("markdown", text, {"title": None})


def test_json_keeps_indent():
    assert W.apply("mdx", ';;;\n{\n    "a": 1\n}\n;;;\n', {"b": 2}) == ';;;\n{\n    "a": 1,\n    "b": 2\n}\n;;;\n'


def test_html_and_xml():
    page = '<html><head>\n  <title>x</title>\n  <meta name="d" content="3">\n</head>'
    out = W.apply("html", page, {"title": "y & <z>", "d": "4", "k": True})
    assert '<title>y &amp; &lt;z></title>' in out.replace("&gt;", ">") and E.EXTRACTORS["html"].extract(out).data == {"title": "y & <z>", "d": "4", "k": True}
    assert W.apply("xml", '<a b="1"/>', {"b": "x<y", "c": 2}) == '<a b="x&lt;y" c="2"/>'
    with pytest.raises(W.WriteError):
        W.apply("xml", "<a/>", {"bad name": 1})
    with pytest.raises(W.WriteError):
        W.apply("html", "<p>x", {"k": 1})


@pytest.mark.parametrize(
    ("file", "text"),
    [
        ("a.dita", '<topic id="x"><title>T</title><body/></topic>'),
        ("a.dita", '<topic id="x"><title>T</title><prolog><author>A</author></prolog><body/></topic>'),
        ("a.dita", '<topic id="x"><title>T</title><prolog><metadata/></prolog></topic>'),
        ("a.dita", '<topic id="x"><title>T</title><prolog><metadata><othermeta name="k" content="o"/></metadata></prolog></topic>'),
        ("a.ditamap", "<map><title>T</title><topicref/></map>"),
        ("a.ditamap", "<map/>"),
    ],
)
def test_dita_entries(file, text):
    out = W.apply("xml", text, {"k": "v", "n": [1]}, file)
    got = E.EXTRACTORS["xml"].extract(out, file).data
    assert got["k"] == "v" and got["n"] == [1] and out.count('name="k"') == 1


def test_refusals():
    assert W.can_write("rst", "T\n=\n") and W.can_write("markdown", "---\nx") and W.can_write("html", "<p>") and W.can_write("asciidoc", "---\na: 1\n---\n") is None


def test_split_body():
    text = "aa\nbbbb\ncc" * 3
    for n in (1, 3, 5, 7, 100):
        parts = FI.split_body(text, n)
        assert "".join(parts) == text and max(map(len, parts)) <= n
    assert FI.split_body("ab\ncdef", 4) == ["ab\n", "cdef"]


def test_candidates_and_gate():
    a = {"required": ["title"], "properties": {"title": {"type": "string", "description": "d"}, "x": {"minimum": 1}, "$schema": {}}}
    b = {"properties": {"title": {"type": "string", "description": "c"}}}
    got = FI.candidates([a, b], {"x": 5}, [])
    assert [(c.key, c.required, c.rule) for c in got] == [("title", True, {"type": "string", "description": "c d"})]
    fields = FI.gate(got, {"title": {"value": "T", "confidence": 0.5, "reasoning": "r"}})
    assert fields[0]["reason"] == "low-confidence"
    lifted, defs = FI.lift_definitions([{"$defs": {"a": {"type": "string"}}}, {"$defs": {"a": {"type": "number"}}, "properties": {"p": {"$ref": "#/$defs/a"}}}])
    assert set(defs["$defs"]) == {"a", "a__1"} and lifted[1]["properties"]["p"]["$ref"] == "#/$defs/a__1"


def test_fill_command(spark, tmp_path, capsys):
    (tmp_path / "a.md").write_text("---\n# keep\ntitle: T\n---\nbody\n")
    (tmp_path / "b.md").write_text("---\ntype: x\n---\n")
    (tmp_path / "c.rst").write_text(":title: T\n")
    (tmp_path / "ans.json").write_text(json.dumps({"type": ["guide", 0.9], "action": ["sleep", 0.95], "resource": ["not a uri", 0.9], "timestamp": ["2024-01-01T00:00:00Z", 0.2]}))
    code = main(["fill", "a.md", "b.md", "c.rst", "--answers", "ans.json"], spark, str(tmp_path))
    out = capsys.readouterr().out
    counts = json.loads(out.splitlines()[-1])
    assert code == 1 and counts["changed"] == 1 and counts["errors"] >= 1
    assert "✎ a.md" in out and '/type  "guide"  0.90  written' in out and "skipped: schema-mismatch" in out and "✗ c.rst" in out
    assert (tmp_path / "a.md").read_text() == "---\n# keep\ntitle: T\ntype: guide\n---\nbody\n"
    main(["fill", "b.md", "c.rst", "--answers", "ans.json", "--format", "github"], spark, str(tmp_path))
    assert "::error file=c.rst::" in capsys.readouterr().out


def test_fill_turns_and_cache(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.md").write_text(f"---\ntitle: T{i}\n---\n")
    run = api.prepare(spark, ["."], str(tmp_path))
    provider = FI.MockProvider({"type": ("guide", 0.9)})
    filled, counts = api.fill(run, provider, dry_run=True)
    assert counts["calls"] == 3 and counts["written"] == 3
    cached = {r["cache_key"]: json.loads(r["proposals"]) for r in filled.collect()}
    _, again = api.fill(run, provider, options=FI.Options(cached=cached), dry_run=True)
    assert again["calls"] == 0 and again["cached"] == 3
    _, none = api.fill(run, provider, options=FI.Options(max_turns=0), dry_run=True)
    assert none["errors"] == 3
    with pytest.raises(ValueError):
        FI.pick_provider({"mock": provider}, None, "m")


def test_max_turns_bounds_the_run(spark, tmp_path):
    for i in range(9):
        (tmp_path / f"{i}.md").write_text(f"---\ntitle: T{i}\n---\n")
    run = api.prepare(spark, ["."], str(tmp_path))
    provider = FI.MockProvider({"type": ("guide", 0.9)})
    for turns, concurrency in ((4, None), (4, 2), (5, 3), (100, 4)):
        _, counts = api.fill(run, provider, options=FI.Options(max_turns=turns, concurrency=concurrency), dry_run=True)
        assert counts["calls"] <= turns and counts["calls"] + counts["errors"] == 9
    assert counts["calls"] == 9


PROGRAM = """
import json, sys
request = json.load(sys.stdin)
open(sys.argv[1], "a").write("x")
if "T3" in request["prompt"]:
    sys.exit("no idea")
found = {"type": {"value": request["model"], "confidence": 0.9, "reasoning": "r"}}
print(json.dumps({k: v for k, v in found.items() if k in request["schema"]["properties"]} | {"$usage": {"input": 10, "output": 3}}))
"""


def test_command_provider_cache_usage_and_flags(spark, tmp_path, capsys):
    for i in range(4):
        (tmp_path / f"{i}.md").write_text(f"---\ntitle: T{i}\n---\n")
    (tmp_path / "p.py").write_text(PROGRAM)
    (tmp_path / "metaloom.config.yaml").write_text("fill:\n  model: guide\n  provider: command\n  concurrency: 2\n")
    words = ["fill", "0.md", "1.md", "2.md", "3.md", "--command", f"{sys.executable} {tmp_path}/p.py {tmp_path}/calls", "--fields", "type", "--dry-run"]
    assert main(words, spark, str(tmp_path)) == 1
    counts = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert (counts["calls"], counts["input_tokens"], counts["output_tokens"], counts["written"], counts["errors"], counts["cost"]) == (4, 30, 9, 3, 1, None)
    # stored proposals are used again, unless the cache is off; prices give a cost
    main(words, spark, str(tmp_path))
    assert (tmp_path / "calls").read_text() == "xxxxx" and json.loads(capsys.readouterr().out.splitlines()[-1])["cached"] == 3
    main([*words, "--no-cache", "--max-turns", "2"], spark, str(tmp_path))
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["calls"] <= 2
    filled = FI.fill(spark.createDataFrame([], "file string, format string, content string, data_json string, schemas array<string>, error string, schema_error string"), api.Registry(), FI.MockProvider({}), [])
    assert FI.summary(filled, (3.0, 15.0)).first()["cost"] == 0.0
    # a model needs a named provider, an unknown one is refused, so is none at all
    for more in (["--no-config", "--model", "m"], ["--provider", "other"]):
        assert main([*words, *more], spark, str(tmp_path)) == 2
    assert main(["fill", "0.md", "--no-config"], spark, str(tmp_path)) == 2


def test_endpoint_provider():
    asked = []
    here = FI.EndpointProvider("http://localhost:1/x", "m", post=lambda url, body, seconds: asked.append(json.loads(body)) or '{"type": 1}')
    assert here.local and here.propose("p", {"properties": {}}) == {"type": 1} and asked == [{"model": "m", "prompt": "p", "schema": {"properties": {}}}]
    far = FI.EndpointProvider("https://example.com/x", post=lambda *_: "[]")
    with pytest.raises(FI.ProviderError):
        far.propose("p", {})
    assert not far.local
    with pytest.raises(ValueError):
        FI.pick_provider({"endpoint": far}, "endpoint", None, local_only=True)
    with pytest.raises(FI.ProviderError):
        FI.EndpointProvider("http://localhost:9/none", timeout=1).propose("p", {})


def test_baseline_flags_without_a_path(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: T\n---\n")
    assert main(["validate", "a.md", "-q"], spark, str(tmp_path)) == 1
    assert main(["validate", "a.md", "--write-baseline"], spark, str(tmp_path)) == 0 and (tmp_path / ".metaloom-baseline.json").exists()
    assert main(["validate", "a.md", "--baseline", "-f", "json"], spark, str(tmp_path)) == 0
    assert main(["validate", "a.md", "--write-baseline", "other.json"], spark, str(tmp_path)) == 0 and (tmp_path / "other.json").exists()
    assert main(["validate", "a.md", "--baseline", "other.json", "--no-config"], spark, str(tmp_path)) == 0
