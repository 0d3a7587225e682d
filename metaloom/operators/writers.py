"""Writing metadata back into documents, keeping everything else as it is.

``apply(format, content, patch)`` sets top-level keys and returns the new text, or raises
``WriteError``.  Every result is read again and compared with the old data and the
patch before it is returned.
"""

from __future__ import annotations

import html as html_lib
import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from metaloom.functions import yamls
from metaloom.functions.values import Moment, dump, load, same

from . import extractors as E

try:
    import yaml
except ImportError:  # pragma: no cover
    yaml = None


class WriteError(ValueError):
    """A document that can't take the patch."""


# -- YAML ---------------------------------------------------------------


def _plain_ok(text: str) -> bool:
    """Whether a string can stand unquoted and still be that string."""
    if not text or text != text.strip() or re.search(r"[\n\r\t\x00-\x1f]", text):
        return False
    if text[0] in "-?:,[]{}#&*!|>'\"%@`" and not re.match(r"-[^\s-]", text):
        return False
    if ": " in text or " #" in text or text.endswith(":"):
        return False
    try:
        return yamls.parse(text) == text and yamls.parse(f"[{text}]") == [text]
    except yamls.YamlError:
        return False


def yaml_scalar(value: Any, quote: str | None = None) -> str:
    if isinstance(value, str):
        if quote == "'" and not re.search(r"[\n\r\x00-\x1f]", value):
            return "'" + value.replace("'", "''") + "'"
        return value if quote is None and _plain_ok(value) else json.dumps(value, ensure_ascii=False)
    return dump(value)


def yaml_flow(value: Any) -> str:
    if isinstance(value, list):
        return "[" + ", ".join(map(yaml_flow, value)) + "]"
    if isinstance(value, dict):
        return "{" + ", ".join(f"{yaml_scalar(k)}: {yaml_flow(v)}" for k, v in value.items()) + "}" if value else "{}"
    text = yaml_scalar(value)
    return json.dumps(text, ensure_ascii=False) if isinstance(value, str) and text == value and re.search(r"[,\[\]{}]", value) else text


def yaml_entry(key: str, value: Any, indent: int = 0) -> str:
    """``key: value`` with block collections, without the last line break."""
    head = " " * indent + yaml_scalar(key) + ":"
    if isinstance(value, list) and value:
        items = []
        for x in value:
            if isinstance(x, dict) and x:
                inner = "\n".join(yaml_entry(k, v, indent + 4) for k, v in x.items())
                items.append(" " * (indent + 2) + "- " + inner[indent + 4 :])
            else:
                items.append(" " * (indent + 2) + "- " + yaml_flow(x))
        return "\n".join([head, *items])
    if isinstance(value, dict) and value:
        return "\n".join([head, *(yaml_entry(k, v, indent + 2) for k, v in value.items())])
    return f"{head} {yaml_flow(value)}"


def merge_yaml(raw: str, patch: dict[str, Any]) -> str:
    """The block with keys set; comments, order, quoting and flow style of the rest stay."""
    node = yamls.compose(raw, exact=True)
    if node is not None and not isinstance(node, yaml.MappingNode):
        raise WriteError("the block is no mapping")
    if node is not None and node.flow_style and node.value:
        return yaml_flow({**yamls.construct(node), **patch})
    edits: list[tuple[int, int, str]] = []
    fresh = dict(patch)
    for k, v in node.value if node is not None else ():
        key = k.value
        if key not in fresh:
            continue
        value = fresh.pop(key)
        start, end = v.start_mark.index, v.end_mark.index
        scalar = isinstance(v, yaml.ScalarNode) and v.style in (None, "'", '"')
        if scalar and not isinstance(value, list | dict):
            lead = " " if raw[start - 1 : start] == ":" else ""
            quote = v.style if v.style is not None and isinstance(value, str) else None
            edits.append((start, end, lead + yaml_scalar(value, quote)))
        elif isinstance(v, yaml.SequenceNode | yaml.MappingNode) and v.flow_style:
            edits.append((start, end, yaml_flow(value)))
        else:
            indent = k.start_mark.column
            stop = end
            if not scalar:  # block collections end where the next token starts; comments before it stay
                stop = k.end_mark.index + len(raw[k.end_mark.index : end].rstrip())
                tail = raw[k.end_mark.index : stop]
                while (cut := re.search(r"\n[ \t]*(?:#[^\n]*)?\Z", tail)) and not isinstance(v, yaml.ScalarNode):
                    tail = tail[: cut.start()]
                stop = k.end_mark.index + len(tail)
            edits.append((k.start_mark.index, stop, yaml_entry(key, value, indent).lstrip(" ")))
    out = raw
    for a, b, text in sorted(edits, reverse=True):
        out = out[:a] + text + out[b:]
    for key, value in fresh.items():
        if out and not out.endswith("\n"):
            out += "\n"
        out += yaml_entry(key, value)
    return out


# -- TOML ---------------------------------------------------------------


def toml_value(value: Any) -> str:
    if value is None or isinstance(value, dict):
        raise WriteError("TOML front matter takes neither null nor tables here")
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, Moment):
        return value.text
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False).replace("\x7f", "\\u007f")
    return "[" + ", ".join(map(toml_value, value)) + "]"


def _toml_value_end(text: str, at: int) -> int:
    """The offset after the value that starts at ``at``."""
    depth = 0
    while at < len(text):
        for mark in ('"""', "'''"):
            if text.startswith(mark, at):
                end = text.find(mark, at + 3)
                while mark == '"""' and end > 0 and text[end - 1] == "\\":
                    end = text.find(mark, end + 1)
                if end < 0:
                    raise WriteError("a string without end")
                at = end + 3
                while at < len(text) and text[at] == mark[0]:
                    at += 1
                break
        else:
            c = text[at]
            if c in "\"'":
                at += 1
                while text[at] != c:
                    at += 2 if c == '"' and text[at] == "\\" else 1
                at += 1
            elif c in "[{":
                depth, at = depth + 1, at + 1
            elif c in "]}":
                depth, at = depth - 1, at + 1
            elif c == "#" and depth:
                at = text.find("\n", at)
            elif (c in "#\n") and not depth:
                break
            else:
                at += 1
    return at - (len(text[:at]) - len(text[:at].rstrip()))


def merge_toml(raw: str, patch: dict[str, Any]) -> str:
    """The block with root keys set by assignment; new keys go before the first table."""
    fresh = {k: toml_value(v) for k, v in patch.items()}
    table = re.search(r"^\s*\[", _blank_values(raw), re.M)
    limit = table.start() if table else len(raw)
    edits = []
    masked = _blank_values(raw)
    for m in re.finditer(r"""^[ \t]*(?:(?P<bare>[\w-]+)|"(?P<basic>[^"\\\n]*)"|'(?P<literal>[^'\n]*)')[ \t]*=[ \t]*""", masked[:limit], re.M | re.A):
        key = raw[slice(*m.span(next(g for g in ("bare", "basic", "literal") if m[g] is not None)))]
        if key in fresh:
            edits.append((m.end(), _toml_value_end(raw, m.end()), fresh.pop(key)))
    if any(k in E.read_toml(raw) for k in fresh):
        raise WriteError("a key is set in a way that can't be edited in place")
    lines = "".join(f"{k if re.fullmatch(r'[A-Za-z0-9_-]+', k) else json.dumps(k, ensure_ascii=False)} = {v}\n" for k, v in fresh.items())
    if lines:
        head = raw[:limit]
        lead = "\n" if head and not head.endswith("\n") else ""
        edits.append((limit, limit, lead + (lines if table else lines.removesuffix("\n"))))
    for a, b, text in sorted(edits, reverse=True):
        raw = raw[:a] + text + raw[b:]
    return raw


def _blank_values(raw: str) -> str:
    """The text with multi-line values masked, so that line patterns only match assignments."""
    out, at = raw, 0
    for m in re.finditer(r"=[ \t]*(?=[\[{\"'])", raw):
        if m.start() < at:
            continue
        try:
            at = _toml_value_end(raw, m.end())
        except (WriteError, IndexError):
            continue
        inner = raw[m.end() : at]
        if "\n" in inner:
            out = out[: m.end()] + re.sub(r"[^\n]", "~", inner) + out[at:]
    return out


# -- JSON ---------------------------------------------------------------


def merge_json(raw: str, patch: dict[str, Any]) -> str:
    """The object again, with its indentation."""
    data = json.loads(raw) if raw.strip() else {}
    if not isinstance(data, dict):
        raise WriteError("the block is no object")
    indent = re.search(r"\n([ \t]+)\S", raw)
    width = None if raw.strip() and "\n" not in raw.strip() else len(indent[1]) if indent else 2
    return dump({**data, **patch}, indent=width)


MERGES: dict[str, Callable[[str, dict[str, Any]], str]] = {"yaml": merge_yaml, "toml": merge_toml, "json": merge_json}


def apply_fenced(content: str, patch: dict[str, Any], create: bool = True) -> str:
    fence = E.locate(content)
    if fence is None:
        if E.opens_fence(content):
            raise WriteError("the front matter has no closing fence")
        if not create:
            raise WriteError("there is no front matter block to write into")
        bom = "\ufeff" if content.startswith("\ufeff") else ""
        body = content.removeprefix("\ufeff")
        eol = "\r\n" if re.search(r"\r\n", body) and not re.search(r"(?<!\r)\n", body) else "\n"
        block = "---\n" + merge_yaml("", patch) + ("\n" if patch else "") + "---\n"
        return bom + (block + ("\n" if body and not body.startswith(("\n", "\r\n")) else "")).replace("\n", eol) + body
    merged = MERGES[fence.flavor](fence.inner(content), patch)
    if merged and not merged.endswith("\n"):
        merged += "\n"
    return content[: fence.inner_start] + merged.replace("\n", fence.eol) + content[fence.inner_end :]


# -- HTML ---------------------------------------------------------------


def scalar_text(value: Any) -> str:
    """The text that reads back as the value, as YAML scalars do."""
    if isinstance(value, list | dict):
        return yaml_flow(value)
    if isinstance(value, str):
        try:
            back = yamls.parse(value) if value else value
        except yamls.YamlError:
            back = value
        return value if back == value and type(back) is str else json.dumps(value, ensure_ascii=False)
    return yaml_scalar(value)


def apply_html(content: str, patch: dict[str, Any]) -> str:
    lead = "\ufeff" if content.startswith("\ufeff") else ""
    read = E.read_html(content)
    body, edits, fresh = read.body, [], []
    for key, value in patch.items():
        kind, found = read.sources.get(key, (None, None))
        if kind == "meta":
            a, b, va, vb = E.content_attribute(found)
            quoted = html_lib.escape(scalar_text(value), quote=True)
            edits.append((found.start + (va if va < vb else b), found.start + vb, f'"{quoted}"' if va < vb else f'="{quoted}"'))
        elif kind == "title" and isinstance(value, str):
            edits.append((found[2], found[3], html_lib.escape(value, quote=False)))
        else:
            fresh.append(f'<meta name="{html_lib.escape(key, quote=True)}" content="{html_lib.escape(scalar_text(value), quote=True)}">')
    if fresh:
        if read.head is None:
            raise WriteError("the page has no <head> tag to write into")
        at = read.head.start + len(read.head.text)
        indent = re.match(r"\r?\n[ \t]*", body[at:])
        pad = indent[0] if indent else "\n"
        edits.append((at, at, "".join(pad + tag for tag in fresh)))
    for a, b, text in sorted(edits, reverse=True):
        body = body[:a] + text + body[b:]
    return lead + body


# -- XML and DITA -------------------------------------------------------

_NAME = re.compile(r"[A-Za-z_][\w.-]*(?::[A-Za-z_][\w.-]*)?\Z")


def xml_attribute(value: Any) -> str:
    text = scalar_text(value)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        text = text.replace(a, b)
    return f'"{text}"'


def apply_xml(content: str, patch: dict[str, Any], file: str | None = None) -> str:
    lead = "\ufeff" if content.startswith("\ufeff") else ""
    read = E.read_xml(content, file)
    if read.root is None:
        raise WriteError("the document has no root element")
    body, root, edits, fresh = read.body, read.root, [], []
    spans = E.attribute_spans(body, root)
    for key, value in patch.items():
        if key in read.others:
            edits.append((*E.attribute_spans(body, read.others[key])["content"], xml_attribute(value)))
        elif key in spans and not key.startswith("xmlns"):
            edits.append((*spans[key], xml_attribute(value)))
        elif read.kind:
            fresh.append(f'<othermeta name={xml_attribute(key)[:-1]}" content={xml_attribute(value)}/>')
        elif not _NAME.match(key) or key.startswith("xmlns"):
            raise WriteError(f"{key!r} can't be the name of an attribute")
        else:
            at = root.tag_end - (2 if body[root.tag_end - 2] == "/" else 1)
            at -= len(body[:at]) - len(body[:at].rstrip())
            edits.append((at, at, f" {key}={xml_attribute(value)}"))
    if fresh:
        edits.append(_dita_edit(body, root, read.kind, fresh))
    for a, b, text in sorted(edits, reverse=True, key=lambda e: e[0]):
        body = body[:a] + text + body[b:]
    return lead + body


_TOPIC_HEAD = ("title", "titlealts", "shortdesc", "abstract")


def _dita_edit(body: str, root: E.Element, kind: str, metas: list[str]) -> tuple[int, int, str]:
    """Where the entries go: into their container, or into one made at its place in the content model."""
    joined = "\n".join(metas)
    if kind == "map":
        container, wrap, heads = root.child("topicmeta"), "<topicmeta>\n{}\n</topicmeta>", ("title",)
        parent = root
    else:
        prolog = root.child("prolog")
        container = prolog.child("metadata") if prolog else None
        parent, heads = (prolog, ()) if prolog else (root, _TOPIC_HEAD)
        wrap = "<metadata>\n{}\n</metadata>" if prolog else "<prolog>\n<metadata>\n{}\n</metadata>\n</prolog>"
    if container is not None:
        if container.end_start == container.tag_end == container.end and body[container.tag_end - 2] == "/":
            return container.tag_end - 2, container.tag_end, f">\n{joined}\n</{container.name}>"
        return container.end_start, container.end_start, joined + "\n"
    made = wrap.format(joined)
    if parent.end == parent.tag_end and body[parent.tag_end - 2] == "/":
        return parent.tag_end - 2, parent.tag_end, f">\n{made}\n</{parent.name}>"
    before = [c.end for c in parent.children if c.name.lower() in heads]
    if parent.name.lower() == "prolog":  # metadata follows the bibliographic elements and precedes the rest
        after = [c for c in parent.children if c.name.lower() in ("resourceid", "data", "data-about", "foreign", "unknown")]
        at = after[0].start if after else parent.end_start
        return at, at, made + "\n"
    at = max(before, default=parent.tag_end)
    return at, at, "\n" + made


WRITERS: dict[str, Callable[[str, dict[str, Any], str | None], str]] = {
    "markdown": lambda content, patch, file: apply_fenced(content, patch),
    "mdx": lambda content, patch, file: apply_fenced(content, patch),
    "asciidoc": lambda content, patch, file: apply_fenced(content, patch, create=False),
    "rst": lambda content, patch, file: apply_fenced(content, patch, create=False),
    "html": lambda content, patch, file: apply_html(content, patch),
    "xml": apply_xml,
}


def apply(name: str, content: str, patch: dict[str, Any], file: str | None = None) -> str:
    """The text with the patch's keys set, verified by reading it again."""
    extractor = E.EXTRACTORS[name]
    try:
        before = extractor.extract(content, file).data
        out = WRITERS[name](content, patch, file)
        after = extractor.extract(out, file).data
    except (E.ExtractError, yamls.YamlError) as e:
        raise WriteError(str(e)) from None
    wanted = {**before, **patch}
    if {k: v for k, v in after.items() if k not in wanted} or not all(k in after and same(after[k], v) for k, v in wanted.items()):
        raise WriteError("the change doesn't read back as it was meant")
    return out


def can_write(name: str, content: str, file: str | None = None) -> str | None:
    """Why a document can't be written to; None if it can: an empty patch is tried."""
    try:
        if name in ("asciidoc", "rst") and E.locate(content) is None:
            raise WriteError("there is no front matter block to write into")
        apply(name, content, {}, file)
        if name == "html" and E.read_html(content).head is None:
            raise WriteError("the page has no <head> tag to write into")
    except WriteError as e:
        return str(e)
    return None


def patch_documents(documents: DataFrame) -> DataFrame:
    """file, content, error of (file, format, content, patch_json) rows: new text, or the old and why."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, errors = [], []
            for file, name, content, patch in zip(*(batch.column(i).to_pylist() for i in range(4))):
                try:
                    out.append(apply(name, content or "", load(patch or "{}"), file))
                    errors.append(None)
                except (WriteError, KeyError) as e:
                    out.append(content)
                    errors.append(str(e) if isinstance(e, WriteError) else f"format {name} can't be written")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(errors, pa.string())], ["file", "content", "error"])

    return documents.select("file", "format", "content", "patch_json").mapInArrow(run, "file string, content string, error string")
