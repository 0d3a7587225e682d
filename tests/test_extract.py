"""Extractors: values, presence, positions, errors."""

import pytest

from metaloom.functions import yamls
from metaloom.functions.pointers import look_up
from metaloom.functions.values import Moment, dump, load
from metaloom.operators import extract as X
from metaloom.operators import extractors as E

YAML = "---\ntype: guide\ntitle: A\ntags:\n  - x\n  - y\nstamp: 2024-05-01T10:00:00Z\n---\nbody\n"


def read(name, text, file=None):
    return E.EXTRACTORS[name].extract(text, file)


def test_yaml_block_keeps_timestamps_as_strings_and_knows_lines():
    found = read("markdown", YAML)
    assert found.present and found.data["stamp"] == "2024-05-01T10:00:00Z"
    assert (found.lines["/type"], found.lines["/tags/1"], found.lines["/stamp"], found.lines[""]) == (2, 6, 7, 1)


@pytest.mark.parametrize("text", ["no block", "---\nopen: 1\n", "--- \na: 1\n---\n", "\n---\na: 1\n---\n", ""])
def test_absent_block(text):
    found = read("markdown", text)
    assert not found.present and found.data == {}


@pytest.mark.parametrize("text", ["---\na: 1\n...\n", "\ufeff---\r\na: 1\r\n---\r\nx", "---\na: 1\n---"])
def test_fence_forms(text):
    assert read("markdown", text).data == {"a": 1}


def test_empty_block_is_present():
    assert read("markdown", "---\n---\n").present
    assert read("mdx", ";;;\n;;;\n").present


@pytest.mark.parametrize(
    ("raw", "value"),
    [("yes", "yes"), ("on", "on"), ("0o17", 15), ("010", 10), ("1.0", 1.0), ("~", None), ("", None), ("TRUE", True), ("1_000", "1_000"), ("1:30", "1:30"), ("2024-01-01", "2024-01-01"), (".5", 0.5), ("'1'", "1")],
)
def test_core_schema(raw, value):
    assert yamls.parse(raw) == value


@pytest.mark.parametrize(
    ("text", "kind"),
    [('---\na: "x\n---\n', "YAML"), ("---\n- 1\n---\n", "YAML"), ("---\na: 1\na: 2\n---\n", "YAML"), ("+++\na = = 1\n+++\n", "TOML"), (";;;\n[1]\n;;;\n", "JSON"), (";;;\n{'a': NaN}\n;;;\n", "JSON")],
)
def test_unreadable(text, kind):
    with pytest.raises(E.ExtractError, match=f"Invalid {kind} frontmatter"):
        read("markdown", text)


def test_alias_bomb_is_refused():
    text = "---\na: &a [1]\nb: [" + ", ".join(["*a"] * 150) + "]\n---\n"
    with pytest.raises(E.ExtractError):
        read("markdown", text)


def test_toml_dates_are_no_strings():
    found = read("markdown", '+++\ntitle = "a"\nday = 2024-05-01\n[meta]\nx = 1\n+++\n')
    assert found.data["day"] == Moment("2024-05-01") and found.lines["/meta"] == 4 and "/meta/x" not in found.lines
    assert load(dump(found.data, moments=True)) == found.data


def test_asciidoc_header():
    found = read("asciidoc", "= Title here\n:a: [1, 2]\n:flag:\n:!off:\n:gone!:\nline\n:b: x\n\n:late: 1\n")
    assert found.data == {"title": "Title here", "a": [1, 2], "flag": True, "off": False, "gone": False, "b": "x"}
    assert found.lines["/b"] == 7


def test_asciidoc_stray_fence_shifts_lines():
    found = read("asciidoc", "---\n= T\n:a: 1\n")
    assert found.data == {"title": "T", "a": 1} and found.lines["/a"] == 3


def test_rst_titles_and_fields():
    found = read("rst", "=====\nTitle\n=====\n\n:type: guide\n:title: Other\n:flag:\n\n:late: 1\n")
    assert found.data == {"title": "Other", "type": "guide", "flag": True} and found.lines["/type"] == 5
    bare = read("rst", "just text\n")
    assert not bare.present and bare.lines == {}
    assert read("rst", "Long title\n===\n").data == {}


def test_xml_attributes_and_columns():
    found = read("xml", '<?xml version="1.0"?>\n<doc id="x"\n  n="3" xmlns:q="u"\n  xml:lang="en">&nope;</doc>')
    assert found.data == {"id": "x", "n": 3, "xml:lang": "en"}
    assert (found.lines["/n"], found.cols["/n"]) == (3, 5)
    with pytest.raises(E.ExtractError):
        read("xml", "<a><b></a>")


def test_dita_entries_win_over_attributes():
    text = '<topic id="a" k="1"><title>T</title><prolog><metadata><othermeta name="k" content="2"/></metadata></prolog></topic>'
    assert read("xml", text, "t.dita").data == {"id": "a", "k": 2}
    assert read("xml", text, "t.xml").data == {"id": "a", "k": 1}
    declared = '<!DOCTYPE topic PUBLIC "-//OASIS//DTD DITA Topic//EN" "topic.dtd">\n' + text
    assert read("xml", declared, "t.xml").data["k"] == 2
    assert read("xml", "<!-- " + declared[:60] + " -->" + text, "t.xml").data["k"] == 1


def test_html_meta_and_title():
    found = read("html", '<html><head>\n<title>A &amp; B</title>\n<meta name="d" content="3">\n<meta\n content="x" property=og>\n<meta name="d" content="4">')
    assert found.data == {"title": "A & B", "d": 4, "og": "x"}
    assert (found.lines["/og"], found.cols["/og"]) == (4, 1)
    assert read("html", '<meta name="title" content="M"><title>T</title>').data == {"title": "M"}
    assert read("html", '<title>T</title><meta name="title" content="M">').data == {"title": "M"}


def test_position_of_nearest_ancestor():
    places = {"": 1, "/a": 2, "/a/0": 3}
    assert [look_up(places, p) for p in ("/a/0/x", "/a/7", "/z", "", "a")] == [3, 2, 1, 1, 2]
    assert look_up({}, "/a") is None


def test_frame(spark):
    rows = [("a.md", YAML), ("b.HTML", "<title>T</title>"), ("c.bin", "x"), ("d.md", None), ("e.md", '---\na: "\n---\n')]
    found = {r["file"]: r for r in X.extract(spark.createDataFrame(rows, "file string, content string")).collect()}
    assert found["a.md"]["format"] == "markdown" and found["a.md"]["lines"]["/type"] == 2
    assert found["b.HTML"]["data_json"] == '{"title":"T"}'
    assert "no extractor" in found["c.bin"]["error"] and not found["d.md"]["present"] and found["e.md"]["error"].startswith("Invalid YAML")
    with pytest.raises(Exception, match="Invalid YAML"):
        X.extract(spark.createDataFrame(rows[4:], "file string, content string"), on_error="raise").collect()


def test_json_blocks_in_the_jvm_agree(spark):
    from pyspark.sql import functions as F

    rows = [(i, t) for i, t in enumerate([';;;\n{"a": 1}\n;;;\n', "\ufeff;;;\r\n{}\r\n;;;\r\n", ";;;\n;;;\n", ";;;\n{bad\n;;;\n", "none"])]
    got = spark.createDataFrame(rows, "i int, content string").select("i", F.to_json(X.json_front_matter(F.col("content"))).alias("j")).orderBy("i").collect()
    assert [r["j"] for r in got] == ['{"a":1}', "{}", "{}", None, None]
