"""Metadata extractors: text in, a dynamic object with positions out."""

from __future__ import annotations

import html as html_lib
import json
import re
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field
from html.parser import HTMLParser
from typing import Any, Protocol
from xml.parsers import expat

from metaloom.functions import yamls
from metaloom.functions.pointers import escape
from metaloom.functions.values import Moment


class ExtractError(ValueError):
    """A metadata block that can't be read."""


@dataclass
class Extraction:
    data: dict[str, Any]
    present: bool
    format: str
    lines: dict[str, int] = field(default_factory=dict)
    cols: dict[str, int] = field(default_factory=dict)


class Extractor(Protocol):
    """The plug-in point: name, file extensions, and how to read (and maybe write) metadata."""

    name: str
    extensions: tuple[str, ...]

    def extract(self, content: str, file: str | None = None) -> Extraction: ...


@dataclass
class Fence:
    """Where a fenced block lies, in characters."""

    flavor: str
    open_start: int
    inner_start: int
    inner_end: int
    close_end: int
    eol: str

    def inner(self, content: str) -> str:
        text = content[self.inner_start : self.inner_end].replace("\r\n", "\n")
        return text.removesuffix("\n")


FLAVORS = {"---": "yaml", "+++": "toml", ";;;": "json"}
_OPEN = re.compile(r"(---|\+\+\+|;;;)\r?\n")


def opens_fence(content: str) -> bool:
    return _OPEN.match(content.removeprefix("\ufeff")) is not None


def locate(content: str) -> Fence | None:
    """The fenced block at the very start; None without one that is closed."""
    at = 1 if content.startswith("\ufeff") else 0
    opened = _OPEN.match(content, at)
    if not opened:
        return None
    closers = {opened[1], "..."} if opened[1] == "---" else {opened[1]}
    cursor = opened.end()
    while cursor <= len(content):
        newline = content.find("\n", cursor)
        end = len(content) if newline < 0 else newline
        if content[cursor:end].removesuffix("\r") in closers:
            eol = "\r\n" if opened[0].endswith("\r\n") else "\n"
            return Fence(FLAVORS[opened[1]], at, opened.end(), cursor, end + (newline >= 0), eol)
        if newline < 0:
            return None
        cursor = newline + 1
    return None


def _object(parsed: Any, label: str) -> dict[str, Any]:
    if parsed is None:
        return {}
    if not isinstance(parsed, dict):
        raise ExtractError(f"Invalid {label} frontmatter: root must be an object")
    return parsed


def _read_yaml(raw: str) -> tuple[dict[str, Any], dict[str, int]]:
    try:
        node = yamls.compose(raw)
        data = _object(None if node is None else yamls.construct(node), "YAML")
        return data, yamls.lines(node, 1)
    except yamls.YamlError as e:
        raise ExtractError(f"Invalid YAML frontmatter: {e}") from None


def _no_constant(name: str) -> Any:
    raise ValueError(f"{name} is not valid JSON")


def _read_json(raw: str) -> tuple[dict[str, Any], dict[str, int]]:
    if not raw.strip():
        return {}, {}
    try:
        parsed = json.loads(raw, parse_constant=_no_constant)
    except (ValueError, RecursionError) as e:
        raise ExtractError(f"Invalid JSON frontmatter: {e}") from None
    data = _object(parsed, "JSON") if parsed is not None else {}
    try:
        return data, yamls.lines(yamls.compose(raw.replace("\t", "  ")), 1)
    except yamls.YamlError:
        return data, {}


_TOML_KEY = re.compile(r"""\s*(?:(?P<bare>[\w-]+)|"(?P<basic>[^"\\]*)"|'(?P<literal>[^']*)')\s*=""", re.ASCII)
_TOML_TABLE = re.compile(r"\s*\[{1,2}\s*([\w-]+)", re.ASCII)


def toml_lines(raw: str, ahead: int) -> dict[str, int]:
    """Lines of root keys and table headers; the first of a name counts."""
    out: dict[str, int] = {}
    at_root = True
    for number, line in enumerate(raw.split("\n"), 1 + ahead):
        if table := _TOML_TABLE.match(line):
            out.setdefault(f"/{escape(table[1])}", number)
            at_root = False
        elif at_root and (key := _TOML_KEY.match(line)):
            name = next(g for g in key.groups() if g is not None)
            out.setdefault(f"/{escape(name)}", number)
    return out


def _moments(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: _moments(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_moments(v) for v in value]
    return value if isinstance(value, str | int | float | bool) else Moment(value)


def read_toml(raw: str) -> dict[str, Any]:
    return _moments(tomllib.loads(raw))


def _read_toml(raw: str) -> tuple[dict[str, Any], dict[str, int]]:
    try:
        return read_toml(raw), toml_lines(raw, 1)
    except (tomllib.TOMLDecodeError, RecursionError) as e:
        raise ExtractError(f"Invalid TOML frontmatter: {e}") from None


READERS: dict[str, Callable[[str], tuple[dict[str, Any], dict[str, int]]]] = {"yaml": _read_yaml, "json": _read_json, "toml": _read_toml}


def read_fenced(content: str, name: str) -> Extraction:
    fence = locate(content)
    if fence is None:
        return Extraction({}, False, name)
    data, lines = READERS[fence.flavor](fence.inner(content))
    return Extraction(data, True, name, {"": 1} | lines)


@dataclass(frozen=True)
class Fenced:
    """Markdown and MDX: front matter or nothing."""

    name: str
    extensions: tuple[str, ...]

    def extract(self, content: str, file: str | None = None) -> Extraction:
        return read_fenced(content, self.name)


_LINES = re.compile(r"\r?\n")
_ADOC_TITLE = re.compile(r"=\s+(.*\S)\s*$")
_ADOC_UNSET = re.compile(r":(?:!([\w-]+)|([\w-]+)!):\s*$", re.ASCII)
_ADOC_SET = re.compile(r":([\w-]+):(?:[ \t]+(.*\S))?\s*$", re.ASCII)


@dataclass(frozen=True)
class AsciiDoc:
    name: str = "asciidoc"
    extensions: tuple[str, ...] = (".adoc", ".asciidoc")

    def extract(self, content: str, file: str | None = None) -> Extraction:
        if opens_fence(content):
            fenced = read_fenced(content, self.name)
            if fenced.present:
                return fenced
            return self._header(content[content.index("\n") + 1 :], 1)
        return self._header(content, 0)

    def _header(self, content: str, ahead: int) -> Extraction:
        data: dict[str, Any] = {}
        lines = {"": 1 + ahead}
        for i, line in enumerate(_LINES.split(content.removeprefix("\ufeff"))):
            if not line.strip():
                break
            key, value = None, None
            if i == 0 and (title := _ADOC_TITLE.match(line)):
                key, value = "title", title[1]
            elif unset := _ADOC_UNSET.match(line):
                key, value = unset[1] or unset[2], False
            elif set_ := _ADOC_SET.match(line):
                key, value = set_[1], True if set_[2] is None else yamls.scalar_or_raw(set_[2])
            if key is not None:
                data[key] = value
                lines[f"/{escape(key)}"] = i + 1 + ahead
        return Extraction(data, bool(data), self.name, lines)


_RST_FIELD = re.compile(r":([^:\s](?:[^:]*[^:\s])?):(?:[ \t]+(.*\S))?\s*$")
_RST_RULE = re.compile(r"([!-/:-@\[-`{-~])\1+\s*$")


@dataclass(frozen=True)
class ReStructuredText:
    name: str = "rst"
    extensions: tuple[str, ...] = (".rst",)

    def extract(self, content: str, file: str | None = None) -> Extraction:
        if opens_fence(content):
            fenced = read_fenced(content, self.name)
            return fenced if fenced.present else self._docinfo(content[content.index("\n") :])
        return self._docinfo(content)

    def _title(self, lines: list[str]) -> tuple[str | None, int, int]:
        """(title, its line from 1, index of the line after it)."""
        at = next((i for i, x in enumerate(lines) if x.strip()), len(lines))
        part = [*lines[at : at + 3], "", "", ""][:3]
        if at == len(lines) or _RST_FIELD.match(part[0]):
            return None, 0, at
        rule = lambda x: (m[1], len(x)) if (m := _RST_RULE.match(x)) else None
        if over := rule(part[0]):
            text = part[1].strip()
            if text and not _RST_FIELD.match(part[1]) and rule(part[2]) == over and over[1] >= len(text):
                return text, at + 2, at + 3
        elif (under := rule(part[1])) and under[1] >= len(part[0].strip()):
            return part[0].strip(), at + 1, at + 2
        return None, 0, at

    def _docinfo(self, content: str) -> Extraction:
        rows = _LINES.split(content.removeprefix("\ufeff"))
        data: dict[str, Any] = {}
        lines: dict[str, int] = {}
        title, line, at = self._title(rows)
        if title is not None:
            data["title"], lines["/title"] = title, line
        while at < len(rows) and not rows[at].strip():
            at += 1
        while at < len(rows) and (found := _RST_FIELD.match(rows[at])):
            name = found[1].strip()
            data[name] = True if found[2] is None else yamls.scalar_or_raw(found[2])
            lines[f"/{escape(name)}"] = at + 1
            line = line or at + 1
            at += 1
        if line:
            lines[""] = line
        return Extraction(data, bool(line), self.name, lines)


def typed(raw: str) -> Any:
    return "" if raw == "" else yamls.scalar_or_raw(raw)


@dataclass
class Element:
    """An XML element with the offsets of its start tag (and of its end)."""

    name: str
    attributes: dict[str, str]
    start: int
    line: int
    col: int
    children: list[Element] = field(default_factory=list)
    end: int = -1
    end_start: int = -1
    tag_end: int = -1

    def child(self, name: str) -> Element | None:
        return next((c for c in self.children if c.name.lower() == name), None)


_ATTRIBUTE = re.compile(r"""\s+([^\s=/>"'<]+)\s*=\s*("[^"]*"|'[^']*')""")
_LINE_BREAKS = re.compile("\r\n|[\n\r\u0085\u2028\u2029]")


def place(text: str, at: int) -> tuple[int, int]:
    """1-based line and column of an offset, over all line breaks of XML."""
    line, last = 1, 0
    for m in _LINE_BREAKS.finditer(text, 0, at):
        line, last = line + 1, m.end()
    return line, at - last + 1


def tag_end(text: str, start: int) -> int:
    """The offset after a start tag's ``>``, quoted ones skipped."""
    quote = ""
    for i in range(start, len(text)):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == ">":
            return i + 1
    return len(text)


def attribute_spans(text: str, element: Element) -> dict[str, tuple[int, int]]:
    """Name to the [start, end) of each quoted attribute value, quotes included."""
    at = text.index("<", element.start) + 1 + len(element.name)
    spans = {}
    while (m := _ATTRIBUTE.match(text, at)) and m.end() <= element.tag_end:
        spans.setdefault(m[1], m.span(2))
        at = m.end()
    return spans


def parse_xml(body: str) -> Element | None:
    """The root element; unknown entities are tolerated, other errors raise."""
    raw = body.encode("utf-8", "surrogatepass")
    parser = expat.ParserCreate("utf-8")
    parser.ordered_attributes = False
    parser.UseForeignDTD(True)  # entities that no DTD declares are skipped, as a reader without the DTD must
    parser.SetParamEntityParsing(expat.XML_PARAM_ENTITY_PARSING_NEVER)
    stack: list[Element] = []
    roots: list[Element] = []
    char_at = _char_offsets(raw)

    def opened(name: str, attributes: dict[str, str]) -> None:
        at = char_at(parser.CurrentByteIndex)
        element = Element(name, attributes, at, *place(body, at), tag_end=tag_end(body, at))
        (stack[-1].children if stack else roots).append(element)
        stack.append(element)

    def closed(name: str) -> None:
        element = stack.pop()
        at = char_at(parser.CurrentByteIndex)
        if body[element.tag_end - 2] != "/" and body.startswith("</", at):
            element.end_start, element.end = at, tag_end(body, at)
        else:
            element.end_start = element.end = element.tag_end

    parser.StartElementHandler, parser.EndElementHandler = opened, closed
    try:
        parser.Parse(raw, True)
    except expat.ExpatError as e:
        if e.code == expat.errors.codes[expat.errors.XML_ERROR_NO_ELEMENTS] and not body.strip():
            return None
        raise ExtractError(f"Invalid XML: {e}") from None
    return roots[0] if roots else None


def _char_offsets(raw: bytes) -> Callable[[int], int]:
    if raw.isascii():
        return lambda i: i
    return lambda i: len(raw[:i].decode("utf-8", "surrogatepass"))


TOPIC_ROOTS = frozenset({"topic", "concept", "task", "reference", "glossentry", "glossgroup"})
MAP_ROOTS = frozenset({"map", "bookmap", "subjectscheme"})
_DITA_DTD = re.compile(r"\b(?:ditabase|" + "|".join(sorted(TOPIC_ROOTS | MAP_ROOTS)) + r")\.dtd\b", re.I)


def doctype(body: str) -> str | None:
    """The document type declaration, internal subset included, comments blanked."""
    masked = re.sub(r"<!--.*?-->", lambda m: " " * len(m[0]), body, flags=re.S)
    start = masked.find("<!DOCTYPE")
    if start < 0:
        return None
    quote, depth = "", 0
    for i in range(start + 9, len(masked)):
        c = masked[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "[]":
            depth += 1 if c == "[" else -1
        elif c == ">" and not depth:
            return masked[start : i + 1]
    return None


def dita_kind(body: str, root: Element, file: str | None) -> str | None:
    """"topic", "map", or None for XML that isn't DITA."""
    name, cls = root.name.lower(), root.attributes.get("class", "")
    path = (file or "").lower()
    declared = doctype(body) or ""
    named = re.match(r"<!DOCTYPE\s+([A-Za-z_][\w.-]*)", declared)
    roots = TOPIC_ROOTS | MAP_ROOTS
    is_dita = (
        re.search("//DTD DITA", declared, re.I) is not None
        or (named is not None and named[1].lower() in roots and _DITA_DTD.search(declared) is not None)
        or re.match(r"\s*[-+]\s+(?:topic|map)/", cls) is not None
        or "DITAArchVersion" in {k.rpartition(":")[2] for k in root.attributes}
        or (path.endswith((".dita", ".ditamap")) and name in roots)
    )
    if not is_dita:
        return None
    return "map" if re.match(r"\s*[-+]\s+map/", cls) or name in MAP_ROOTS or path.endswith(".ditamap") else "topic"


def dita_container(root: Element, kind: str) -> Element | None:
    """The element that holds ``othermeta``."""
    if kind == "map":
        return root.child("topicmeta")
    prolog = root.child("prolog")
    return prolog.child("metadata") if prolog else None


@dataclass
class XmlRead:
    body: str
    root: Element | None
    extraction: Extraction
    kind: str | None = None
    others: dict[str, Element] = field(default_factory=dict)


def read_xml(content: str, file: str | None = None) -> XmlRead:
    body = content.removeprefix("\ufeff")
    root = parse_xml(body)
    if root is None:
        return XmlRead(body, None, Extraction({}, False, "xml"))
    data: dict[str, Any] = {}
    lines, cols = {"": root.line}, {"": root.col}
    spans = attribute_spans(body, root)
    for name, value in root.attributes.items():
        if name == "xmlns" or name.startswith("xmlns:"):
            continue
        data[name] = typed(value)
        line, col = place(body, spans[name][0]) if name in spans else (root.line, root.col)
        lines[f"/{escape(name)}"], cols[f"/{escape(name)}"] = line, col
    read = XmlRead(body, root, Extraction(data, False, "xml", lines, cols), dita_kind(body, root, file))
    if read.kind and (container := dita_container(root, read.kind)):
        for child in container.children:
            key, value = child.attributes.get("name"), child.attributes.get("content")
            if child.name.lower() == "othermeta" and key and value is not None:
                data[key] = typed(value)
                read.others[key] = child
                lines[f"/{escape(key)}"], cols[f"/{escape(key)}"] = child.line, child.col
    read.extraction.present = bool(data)
    return read


@dataclass(frozen=True)
class Xml:
    name: str = "xml"
    extensions: tuple[str, ...] = (".xml", ".dita", ".ditamap")

    def extract(self, content: str, file: str | None = None) -> Extraction:
        return read_xml(content, file).extraction


@dataclass
class HtmlTag:
    name: str
    attributes: dict[str, str]
    start: int
    text: str


class _HtmlReader(HTMLParser):
    def __init__(self, body: str):
        super().__init__(convert_charrefs=False)
        self.body = body
        self.starts = [0, *(m.end() for m in re.finditer("\n", body))]
        self.metas: list[HtmlTag] = []
        self.titles: list[tuple[HtmlTag, list[str], list[int]]] = []
        self.order: list[tuple[str, Any]] = []
        self.head: HtmlTag | None = None
        self._title: list[str] | None = None

    def _tag(self, name: str, attributes: list[tuple[str, str | None]]) -> HtmlTag:
        line, col = self.getpos()
        kept: dict[str, str] = {}
        for k, v in attributes:
            kept.setdefault(k, v or "")
        return HtmlTag(name, kept, self.starts[line - 1] + col, self.get_starttag_text() or "")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "meta":
            self.order.append(("meta", self._tag(tag, attrs)))
        elif tag == "title":
            found = self._tag(tag, attrs)
            at = found.start + len(found.text)
            end = re.compile(r"</title\s*>", re.I).search(self.body, at)
            text = self.body[at : end.start() if end else len(self.body)]
            self.order.append(("title", (found, html_lib.unescape(text), at, end.start() if end else len(self.body))))
        elif tag == "head" and self.head is None:
            self.head = self._tag(tag, attrs)


@dataclass
class HtmlRead:
    body: str
    extraction: Extraction
    sources: dict[str, tuple[str, Any]]
    head: HtmlTag | None


def read_html(content: str) -> HtmlRead:
    """``<meta>`` and ``<title>`` of any page; never fails."""
    body = content.removeprefix("\ufeff")
    reader = _HtmlReader(body)
    reader.feed(body)
    reader.close()
    data: dict[str, Any] = {}
    lines, cols = {"": 1}, {"": 1}
    sources: dict[str, tuple[str, Any]] = {}
    breaks = reader.starts

    def at(offset: int) -> tuple[int, int]:
        import bisect

        line = bisect.bisect_right(breaks, offset)
        return line, offset - breaks[line - 1] + 1

    for kind, found in reader.order:
        if kind == "title":
            if "title" in data:
                continue
            key, value, (line, col) = "title", found[1], at(found[0].start)
        else:
            key, raw = found.attributes.get("name", found.attributes.get("property")), found.attributes.get("content")
            if key is None or raw is None:
                continue
            value, (line, col) = typed(raw), at(found.start)
            if span := content_attribute(found):
                own_line, own_col = at(found.start + span[0])
                col = own_col if own_line == line else col
        data[key] = value
        sources[key] = (kind, found)
        lines[f"/{escape(key)}"], cols[f"/{escape(key)}"] = line, col
    return HtmlRead(body, Extraction(data, bool(data), "html", lines, cols), sources, reader.head)


_HTML_ATTRIBUTE = re.compile(r"""[\s/]+([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")


def content_attribute(tag: HtmlTag) -> tuple[int, int, int, int] | None:
    """Offsets in the tag's text: the content attribute's start and end, and its value's."""
    at = 1 + len(tag.name)
    while m := _HTML_ATTRIBUTE.match(tag.text, at):
        if m[1].lower() == "content":
            value = m.span(2) if m[2] is not None else (m.end(), m.end())
            return m.start(1), m.end(), *value
        at = m.end()
    return None


@dataclass(frozen=True)
class Html:
    name: str = "html"
    extensions: tuple[str, ...] = (".html", ".htm")

    def extract(self, content: str, file: str | None = None) -> Extraction:
        return read_html(content).extraction


EXTRACTORS: dict[str, Extractor] = {
    e.name: e for e in (Fenced("markdown", (".md", ".markdown")), Fenced("mdx", (".mdx",)), AsciiDoc(), ReStructuredText(), Xml(), Html())
}


def by_extension(extractors: dict[str, Extractor] | None = None) -> dict[str, str]:
    """Lower-cased extension to format."""
    return {ext: name for name, e in (extractors or EXTRACTORS).items() for ext in e.extensions}
