"""Secret scans through nested encodings.

Every text is scanned as it stands (the *base* findings), then a worklist of
layers is unwrapped: a layer whose URL escapes, Unicode or entity escapes, base64
tokens, or gzip, zlib, bz2, xz or zstd data can be decoded gives child layers for each
kind of wrapping.  Decompression is a layer like any other.  Bytes that aren't UTF-8 and
characters that can't be printed are decoded too, one by one.  A digest of every layer
seen breaks cycles (data that unpacks to itself, too) and joins layers reached in
different orders, so the worklist runs to a fixpoint.  Each character of a layer
carries the slice of the original text that it came from; a finding in a layer is
reported over the original slice.

Any longer word can be decoded to something, so base64 tokens are decoded in grades,
surest first (see ``_grade``).  A token that doesn't decode to text is also tried from its
second, third and fourth character, as one may be glued to a path or a prefix, and
lines of base64 are joined.

Data that expands beyond ``BLOCK`` bytes is scanned a block at a time, cut where no
secret or code can stand if there is such a place.  After ``max_expanded`` bytes, over
all layers of a text, unpacking ends: what is packed beyond is reported whole, as
*opaque*, so that nothing passes unseen (and ``redact`` takes it away).

Spans are ``kind:start:end`` in code points of the original text, end exclusive.
Kinds, in order: assign, access, hex (base), then decoded-assign, decoded-access,
decoded-hex, opaque.  A decoded finding is reported where the layer's text of the match
differs from the original slice, i.e. where decoding took part in it.

Defined results: a null text is empty and has no spans; repeated rows give a row
each; a null doc_id stays null; an empty table gives no rows; a very long text is
scanned whole; other columns are ignored in ``scan`` and kept in ``redact``.
``n_oversize`` counts a text's opaque tokens.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import html
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, *(f"decoded-{k}" for k in BASE_KINDS), "opaque")
_ORDER = {k: i for i, k in enumerate(KINDS)}

#: Bytes unpacked from one text beyond which what is left is reported as opaque.
MAX_EXPANDED = 1 << 30
#: Bytes of unpacked data that are scanned together.
BLOCK = 4 << 20

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The base findings, by start and then kind."""
    found: list[Span] = []
    low = text.lower()
    if any(word in low for word in _KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return ordered(found)


def ordered(spans) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], _ORDER[s[0]], s[2]))


def render(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


#: Nested escapes of the per cent sign are one unit: the layers between hold nothing but digits.
_URL_UNIT = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
_URL = re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|quot|amp|lt|gt|apos|colon|equals);")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}\r?\n)+[A-Za-z0-9+/_-]+={0,2}")
#: Shorter tokens, if all of their bytes can only be printable ASCII.
_QUAD = "[I-Za-f][" + "".join(c for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") if 2 <= i & 15 <= 7) + "][ABEFIJMNQRUVYZcdghklopstwx014589][A-Za-z0-9+/_-]"
_SHORT = re.compile(rf"[I-Za-f](?<![A-Za-z0-9+/_-].){_QUAD[8:]}(?:{_QUAD}){{1,2}}(?:[A-Za-z0-9]{{2}}={{0,2}}|[A-Za-z0-9]{{3}}=?)?(?![A-Za-z0-9+/_=-])")
#: Where compressed data may begin, as text; 0xDA begins a character together with some bytes.
_MAGIC = re.compile("\x1f\udc8b|x[\x01^\udc9c\udcdaڀ-ڿ]|BZh[1-9]1AY&SY|\udcfd7zXZ\0|\\(\udcb5/\udcfd")
_HINTS = ("\x1f\udc8b", "x\x01", "x^", "x\udc9c", "x\udcda", "BZh", "\udcfd7zXZ\0", "(\udcb5/\udcfd")

#: New text for a part of a layer, and for each of its characters the slice of the layer it stands for.
Pieces = tuple[str, np.ndarray, np.ndarray]


def _decoded(raw: bytes) -> tuple[str, np.ndarray]:
    """The text and the bytes before each character, and in all; a byte that isn't UTF-8 is a character of its own."""
    text = raw.decode("utf-8", "surrogateescape")
    if len(text) == len(raw):
        return text, np.arange(len(raw) + 1)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    width = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
    width[(code >= 0xDC80) & (code < 0xDD00)] = 1
    return text, np.concatenate(([0], np.cumsum(width)))


def _unwrap_url(text: str, found: re.Match, stats: dict) -> Pieces:
    units = list(_URL_UNIT.finditer(text, found.start(), found.end()))
    plain, byte = _decoded(bytes(int(u[1], 16) for u in units))
    at = np.array([*(u.start() for u in units), found.end()])[byte]
    return plain, at[:-1], at[1:]


def _unwrap_escape(text: str, found: re.Match, stats: dict) -> Pieces | None:
    whole, at, to = found[0], found.start(), found.end()
    if whole.startswith("&"):
        got = html.unescape(whole)
        return None if got == whole else (got, np.full(len(got), at), np.full(len(got), to))
    if whole.startswith("\\u") and whole[2] != "{":
        units = [int(whole[i + 2 : i + 6], 16) for i in range(0, len(whole), 6)]
        chars, cuts, i = [], [at], 0
        while i < len(units):
            u, n = units[i], 1
            if 0xD800 <= u < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000:
                u, n = 0x10000 + ((u - 0xD800) << 10) + units[i + 1] - 0xDC00, 2
            i += n
            chars.append(chr(u))  # a lone surrogate too
            cuts.append(at + 6 * i)
        return "".join(chars), np.array(cuts[:-1]), np.array(cuts[1:])
    code = int(whole.strip("\\uUx{}"), 16)
    return None if code > 0x10FFFF or 0xD800 <= code < 0xE000 else (chr(code), np.array([at]), np.array([to]))


def _inflate(raw: bytes) -> tuple[Iterator[bytes], list[int]]:
    """(blocks of the data packed at the start of ``raw``, the bytes that they took once they are read).

    Data that ends early or is damaged gives what is there and takes no bytes.
    """
    used = [0]

    def blocks(unpack, errors) -> Iterator[bytes]:
        try:
            data = raw
            while True:
                out = unpack.decompress(data, BLOCK)
                if out:
                    yield out
                if unpack.eof:
                    used[0] = len(raw) - len(unpack.unused_data)
                    return
                data = getattr(unpack, "unconsumed_tail", b"")
                if not out and not data:
                    return
        except errors:
            return

    def frames() -> Iterator[bytes]:
        unpack = zstandard.ZstdDecompressor().decompressobj()
        try:
            for at in range(0, len(raw), 128):
                if out := unpack.decompress(raw[at : at + 128]):
                    yield out
                if unpack.eof:
                    used[0] = min(len(raw), at + 128) - len(unpack.unused_data)
                    return
        except zstandard.ZstdError:
            return

    if raw[:2] == b"\x1f\x8b":
        return blocks(zlib.decompressobj(31), zlib.error), used
    if raw[:1] == b"x":
        return blocks(zlib.decompressobj(), zlib.error), used
    if raw[:3] == b"BZh":
        return blocks(bz2.BZ2Decompressor(), (OSError, EOFError, ValueError)), used
    if raw[:6] == b"\xfd7zXZ\x00":
        return blocks(lzma.LZMADecompressor(), (lzma.LZMAError, EOFError)), used
    return frames(), used


#: How sure it is that a base64 token was one.  Any longer word can be decoded to
#: something: each grade has a layer with its tokens and those of the surer grades
#: decoded, so that a word that is none is left alone in the layers before.  The last
#: three begin behind a token's first, second and third character.
PRINTABLE, UTF8, BYTES, SHIFTED = range(4)
_TELLING = re.compile("[\x20-\x7e]{6}|" + _MAGIC.pattern)


def _grade(text: str) -> int:
    if all(c.isprintable() or c in "\t\n\r" for c in text):
        return PRINTABLE
    return BYTES if any("\udc80" <= c <= "\udcff" for c in text) else UTF8


def _from_base64(body: str, at: np.ndarray, to: int) -> Pieces | None:
    """The decoded text of a token's characters, that stand at ``at``; the token ends at ``to``."""
    if len(body) % 4 == 1:
        return None
    raw = base64.b64decode(body.translate(_PLAIN) + "=" * (-len(body) % 4))
    plain, byte = _decoded(raw)
    if not plain:
        return None
    ends = np.append(at, to)[np.minimum(len(at), -(-4 * byte[1:] // 3))]
    ends[-1] = to
    return plain, at[4 * byte[:-1] // 3], ends


_PLAIN = str.maketrans("-_", "+/")


def _tokens(layer: Layer) -> Iterator[Layer]:
    """Layers with base64 tokens decoded."""
    text = layer.text
    sure: list[tuple[int, int, Pieces]] = []
    rest: dict[int, list[tuple[int, int, Pieces]]] = {}
    for found in [*_BASE64.finditer(text), *_SHORT.finditer(text)]:
        body, a = found[0].rstrip("="), found.start()
        at = np.arange(a, a + len(body))
        got = _from_base64(body, at, found.end())
        if got is not None and (grade := _grade(got[0])) == PRINTABLE:
            sure.append((a, found.end(), got))
            continue
        if len(body) < 16:
            continue
        if got is not None:
            rest.setdefault(grade, []).append((a, found.end(), got))
        for shift in (1, 2, 3):
            part, place = body[shift:], at[shift:]
            if len(part) % 4 == 1:
                part, place = part[:-1], place[:-1]
            got = _from_base64(part, place, found.end())
            if got is not None and _TELLING.search(got[0]):
                rest.setdefault(SHIFTED + shift, []).append((a + shift, found.end(), got))
    if sure:
        yield layer.replaced(sorted(sure, key=lambda e: e[0]))
    less: list[tuple[int, int, Pieces]] = []
    for grade in sorted(rest):
        less = [*less, *rest[grade]] if grade < SHIFTED else rest[grade]
        yield layer.replaced(sorted([*sure, *less], key=lambda e: e[0]))
    lines = []
    for found in _LINES.finditer(text):
        at = np.array([i for i in range(found.start(), found.end()) if text[i] not in "\r\n="])
        if (got := _from_base64("".join(map(text.__getitem__, at)), at, found.end())) is not None:
            lines.append((found.start(), found.end(), got))
    if lines:
        yield layer.replaced(lines)


def _safe_end(text: str) -> int:
    """Where a block of text is best cut: behind its last character that no secret and no code holds, or at its end."""
    found = _OUTSIDE.search(text[::-1])
    return len(text) - found.start() if found else len(text)


_OUTSIDE = re.compile(r"[^A-Za-z0-9+/_.=\-\"': %\\&#;{}\r\n\udc80-\udcff\x00-\x1f\x7f]")


def _unpacked(layer: Layer, stats: dict) -> Iterator[Layer]:
    """Layers with compressed data expanded: small data in its place, large or incomplete data in layers of its own."""
    text, edits, at = layer.text, [], 0
    if not any(h in text for h in _HINTS) and (text.isascii() or not _MAGIC.search(text)):
        return
    while found := _MAGIC.search(text, at):
        a = found.start()
        at = a + 1
        if not _may_unpack(text[a : a + 512]):
            continue
        # packed data goes on at most for as long as characters are decoded ones
        plain = () if layer.starts is None else np.flatnonzero(layer.ends[a:] - layer.starts[a:] == 1)
        to = a + int(plain[0]) if len(plain) else len(text)
        lone = _LONE.search(text, a, to)
        raw = text[a : lone.start() if lone else to].encode("utf-8", "surrogateescape")
        blocks, used = _inflate(raw)
        held, large = b"", False
        for block in blocks:
            stats["expanded"] += len(block)
            held += block
            if stats["expanded"] > stats["max_expanded"]:
                stats["opaque"].add(layer.span(a, to))
                break
            if len(held) > BLOCK:
                large = True
                plain = _decoded(held)[0]
                cut = _safe_end(plain)
                yield Layer.over(plain[:cut], *layer.span(a, to))
                held = plain[cut:].encode("utf-8", "surrogateescape")
        if not held:
            continue
        if used[0]:
            to = min(to, a + len(_decoded(raw[: used[0]])[0]))
        plain = _decoded(held)[0]
        if large or not used[0]:
            yield Layer.over(plain, *layer.span(a, to))
        else:
            edits.append((a, to, (plain, np.full(len(plain), a), np.full(len(plain), to))))
        if used[0]:
            at = to
    if edits:
        yield layer.replaced(edits)


def _may_unpack(text: str) -> bool:
    """Whether the beginning of data unpacks without an error."""
    lone = _LONE.search(text)
    raw = (text[: lone.start()] if lone else text).encode("utf-8", "surrogateescape")
    try:
        if raw[:1] == b"x":
            zlib.decompressobj().decompress(raw)
        elif raw[:1] == b"\x1f":
            zlib.decompressobj(31).decompress(raw)
    except zlib.error:
        return False
    return True


#: Surrogates that stand for no byte.
_LONE = re.compile("[\ud800-\udc7f\udd00-\udfff]")


_WRAPPINGS = (
    (lambda t: "%" in t, _URL, _unwrap_url),
    (lambda t: "\\" in t or "&" in t, _ESCAPE, _unwrap_escape),
)


class Layer:
    """A text and, for each of its characters, the slice of the original it stands for.

    The original itself has no arrays: its characters stand for themselves.
    """

    __slots__ = ("ends", "starts", "text")

    def __init__(self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None):
        self.text, self.starts, self.ends = text, starts, ends

    @classmethod
    def over(cls, text: str, a: int, b: int) -> Layer:
        """A layer all of whose characters stand for one slice."""
        return cls(text, np.broadcast_to(np.int64(a), len(text)), np.broadcast_to(np.int64(b), len(text)))

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self.starts is None:
            return a, b
        return int(self.starts[a:b].min()), int(self.ends[a:b].max())

    def replaced(self, edits: list[tuple[int, int, Pieces]]) -> Layer:
        n = len(self.text)
        own_a = np.arange(n, dtype=np.int64) if self.starts is None else self.starts
        own_b = np.arange(1, n + 1, dtype=np.int64) if self.ends is None else self.ends
        text, starts, ends, at = [], [], [], 0
        for a, b, (new, x, y) in edits:
            text += [self.text[at:a], new]
            starts.append(own_a[at:a])
            ends.append(own_b[at:a])
            if self.starts is None:
                starts.append(x)
                ends.append(y)
            else:
                cuts = np.stack((x, y), 1).ravel() - a
                starts.append(np.minimum.reduceat(np.append(own_a[a:b], 0), cuts)[::2])
                ends.append(np.maximum.reduceat(np.append(own_b[a:b], 0), cuts)[::2])
            at = b
        text.append(self.text[at:])
        starts.append(own_a[at:])
        ends.append(own_b[at:])
        return Layer("".join(text), np.concatenate(starts), np.concatenate(ends))


def children(layer: Layer, stats: dict) -> Iterator[Layer]:
    for likely, pattern, unwrap in _WRAPPINGS:
        if not likely(layer.text):
            continue
        edits = [(m.start(), m.end(), got) for m in pattern.finditer(layer.text) if (got := unwrap(layer.text, m, stats)) is not None]
        if edits:
            yield layer.replaced(edits)
    yield from _tokens(layer)
    yield from _unpacked(layer, stats)


def scan_text(text: str | None, max_expanded: int = MAX_EXPANDED) -> tuple[list[Span], list[Span], int, int]:
    """(base spans, all spans, layers unwrapped, opaque tokens)."""
    text = text or ""
    base = base_spans(text)
    stats = {"max_expanded": max_expanded, "expanded": 0, "opaque": set()}
    more: set[Span] = set()
    seen = {_digest(text)}
    # the worklist: what is left of each open layer's children, so that one of each depth is held
    work = [children(Layer(text), stats)]
    layers = 0
    while work:
        child = next(work[-1], None)
        if child is None:
            work.pop()
            continue
        if (key := _digest(child.text)) in seen:
            continue
        seen.add(key)
        layers += 1
        work.append(children(child, stats))
        for kind, a, b in base_spans(child.text):
            x, y = child.span(a, b)
            if child.text[a:b] != text[x:y]:
                more.add((f"decoded-{kind}", x, y))
    more |= {("opaque", a, b) for a, b in stats["opaque"]}
    return base, ordered([*base, *more]), layers, len(stats["opaque"])


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def scan(docs: DataFrame, max_expanded: int = MAX_EXPANDED) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_spans, spans, n_layers, n_oversize of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_spans", "spans", "n_layers", "n_oversize")}
            for text in batch.column(1):
                base, spans, layers, oversize = scan_text(text.as_py(), max_expanded)
                for kind in BASE_KINDS:
                    rows[f"n_{kind}"].append(sum(s[0] == kind for s in base))
                rows["base_spans"].append(render(base))
                rows["spans"].append(render(spans))
                rows["n_layers"].append(layers)
                rows["n_oversize"].append(oversize)
            columns = [batch.column(0).cast(pa.int64())]
            columns += [pa.array(v, pa.string() if "spans" in k else pa.int64()) for k, v in rows.items()]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *rows])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string, n_layers long, n_oversize long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redact_text(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones joined, replaced by ``mark``."""
    out, at, end = [], 0, -1
    for _, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a > end:
            out += [text[at:a], mark]
            end = b
        else:
            end = max(end, b)
        at = end
    out.append(text[at:])
    return "".join(out)


def redact(docs: DataFrame, mark: str = "[SECRET]", max_expanded: int = MAX_EXPANDED) -> DataFrame:
    """The rows of ``docs``, all columns, secrets in ``text`` replaced; a null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = []
            for text in batch.column(at):
                t = text.as_py()
                spans = scan_text(t, max_expanded)[1] if t else []
                texts.append(redact_text(t, spans, mark) if spans else t)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(common.read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans"), 256).alias("base_sha256"), "spans", "n_layers", "n_oversize"
    )
