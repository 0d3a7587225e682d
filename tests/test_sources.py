"""Fetching, caching, vendoring, writing, folders read by Spark, baselines read by Spark."""

import http.server
import json
import os
import threading
import time

import pytest

from metaloom.operators import baseline as B
from metaloom.operators.jsonschema import SchemaError
from metaloom.sources import files, registry, sinks, vendor
from metaloom.sources.registry import DiskCache, Registry

SCHEMA = b'{"type": "object"}'


@pytest.fixture
def server(monkeypatch):
    monkeypatch.setattr(registry, "RETRY_S", 0)
    answers, seen = {}, []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append(self.path)
            code, body = answers[self.path].pop(0)
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    httpd = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}", answers, seen
    httpd.shutdown()


def test_fetch_tries_server_errors_once_more(server):
    url, answers, seen = server
    answers["/a"] = [(503, b""), (200, SCHEMA)]
    answers["/b"] = [(404, b"")]
    answers["/c"] = [(500, b""), (500, b"")]
    assert registry.http_fetch(url + "/a") == SCHEMA
    for path in ("/b", "/c"):
        with pytest.raises(SchemaError):
            registry.http_fetch(url + path)
    assert seen == ["/a", "/a", "/b", "/c", "/c"]


def test_body_has_a_bound(server, monkeypatch):
    url, answers, _ = server
    monkeypatch.setattr(registry, "MOST_BYTES", 10)
    answers["/a"] = [(200, b"x" * 11)]
    with pytest.raises(SchemaError, match="larger"):
        registry.http_fetch(url + "/a")


def test_cache(tmp_path):
    calls = []

    def fetch(url):
        calls.append(url)
        return SCHEMA

    url, cache = "https://example.com/s.json", DiskCache(str(tmp_path / "c"))
    for _ in range(2):
        assert Registry(fetch=fetch, cache=cache).load(url) == {"type": "object"}
    assert len(calls) == 1
    path = cache._path(url)
    old = time.time() - 25 * 3600
    os.utime(path, (old, old))
    assert cache.read(url) is None and cache.read(url, offline=True) == SCHEMA
    os.utime(path, (time.time() + 30, time.time() + 30))
    assert cache.read(url) == SCHEMA
    os.utime(path, (time.time() + 3600, time.time() + 3600))
    assert cache.read(url) is None
    for bad in (b"{", b"[]", b'{"title": 1}', b"\xff"):
        with open(path, "wb") as f:
            f.write(bad)
        assert cache.read(url) is None
    assert DiskCache(str(tmp_path), 0).read(url) is None
    with pytest.raises(SchemaError, match="offline"):
        Registry(offline=True, fetch=fetch, cache=cache).load(url)


def test_failed_loads_are_not_kept(tmp_path):
    bodies = [b"nope", SCHEMA]
    one = Registry(fetch=lambda url: bodies.pop(0))
    with pytest.raises(SchemaError):
        one.load("https://example.com/x")
    assert one.load("https://example.com/x") == {"type": "object"} and one.load("https://example.com/x") == {"type": "object"}


def test_published_addresses_are_never_fetched():
    url = "https://example.org/okf.json"
    one = Registry(fetch=None, aliases={url: "google:okf:0.1"})
    assert one.load(url)["$id"] == "google:okf:0.1"
    one.extra["own"] = {"$ref": url}
    assert [v.keyword for v in one.compile("own").evaluate({})] == ["required"]


def test_vendor(tmp_path):
    url = "https://example.com/a%20b/schema"
    path, entries = vendor.vendor(url, Registry(fetch=lambda u: SCHEMA), "schemas", str(tmp_path), ["x.json", url])
    assert path == os.path.join("schemas", "example.com-a-b-schema.json") and (tmp_path / path).read_bytes() == SCHEMA
    assert entries[0] == "x.json" and entries[1]["source"] == url and entries[1]["integrity"] == registry.digest(SCHEMA)
    assert len(vendor.fold(entries, "new.json", url, "sha256-x")) == 2
    with pytest.raises(SchemaError):
        vendor.vendor(url, Registry(fetch=lambda u: b"{}"), "schemas", str(tmp_path))


def test_atomic_writes(tmp_path, spark):
    path = tmp_path / "a.md"
    path.write_text("old")
    os.chmod(path, 0o640)
    sinks.write_atomic(str(path), "new\r\n")
    assert path.read_bytes() == b"new\r\n" and os.stat(path).st_mode & 0o777 == 0o640 and os.listdir(tmp_path) == ["a.md"]
    with pytest.raises(FileExistsError):
        sinks.refuse_target("a.md", str(tmp_path))
    rows = spark.createDataFrame([("a.md", "x"), ("no/such/b.md", "y")], "file string, content string")
    errors = {r["file"]: r["error"] for r in sinks.write_files(rows, str(tmp_path)).collect()}
    assert errors["a.md"] is None and errors["no/such/b.md"] and path.read_text() == "x"


def test_folder_read_by_spark(tmp_path, spark):
    for name in ("a.md", "b c.MD", "x.txt", "node_modules/m.md", "sub/d.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(f"---\nn: {name}\n---\n")
    rows = files.read_folder(spark, str(tmp_path), ["md"]).collect()
    assert sorted(os.path.relpath(r["file"], tmp_path) for r in rows) == ["a.md", "b c.MD", "sub/d.md"]
    assert all(r["content"].startswith("---\nn: ") and r["content"].endswith("---\n") for r in rows)


def test_baseline_files(tmp_path, spark):
    entries = {"b.md": ["0" * 16, "f" * 16], "a.md": ["1" * 16]}
    text = B.serialize(entries)
    assert list(json.loads(text)["entries"]) == ["a.md", "b.md"] and B.parse(text) == entries
    (tmp_path / "base.json").write_text(text)
    got = B.read_table(spark, str(tmp_path / "base.json")).collect()
    assert sorted((r["file"], r["fingerprint"]) for r in got) == sorted((f, p) for f, ps in entries.items() for p in ps)
    assert B.read(str(tmp_path / "none.json")) is None
    for bad in ("{", '{"version": 2, "entries": {}}', '{"version": 1, "entries": {"a": ["xyz"]}}'):
        with pytest.raises(B.BaselineError):
            B.parse(bad)


def test_baseline_bases(tmp_path):
    base = B.Base(str(tmp_path), str(tmp_path / "docs"), str(tmp_path / "docs"))
    assert base.file("legacy.md") == "docs/legacy.md" and base.schema("../s.json") == "s.json" and base.schema("google:okf:0.1") == "google:okf:0.1"


def test_folders_with_a_scheme_are_listed_by_spark(spark, tmp_path, capsys):
    from metaloom.cli import main

    for name, text in (("a.md", "---\ntitle: A\n---\n"), ("sub/b.md", "---\ntitle: B\n---\n"), ("c.txt", "no"), ("node_modules/d.md", "no")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    assert main(["get", "--fields", "title", f"file://{tmp_path}", "-f", "json"], spark, str(tmp_path)) == 0
    out = capsys.readouterr().out
    assert '"title":"A"' in out and '"title":"B"' in out and len(out.splitlines()) == 2
