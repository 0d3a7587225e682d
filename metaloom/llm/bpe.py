"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut at *safe boundaries*, places where no match of the splitting
pattern can begin before and end after, so that encoding the parts one by one
gives exactly the ids of the whole:

* before one ASCII space between two letters or digits (a letter or digit run never
  takes in a following space, and the space starts the next match);
* between an ideograph, kana or Hangul letter and a full stop, comma or mark of those
  scripts (a run of letters ends there, and no contraction begins);
* between an ASCII letter and an ASCII digit, either way round (no alternative
  of the pattern holds both).

Letters are those of Latin, Greek, Cyrillic, Han, kana and Hangul blocks that all
versions of Unicode agree on.  A text without such a place stays whole.  Decoding joins raw bytes, so a
character whose bytes are spread over several ids comes back intact.

Defined results: a null text is the empty text (no ids, digest of no bytes);
repeated rows and equal ids give a row each; an empty table gives no rows; other
columns of the input are ignored, whatever their names; a null id stays null.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from . import common

#: Texts longer than this are encoded in parts of at least so many characters.
PART_CHARS = 1 << 16

_WIDE = "ぁ-ゖァ-ヺ一-龥가-힣"
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏΑ-ΡΣ-ωЁА-яё" + _WIDE
SAFE = regex.compile(rf"(?<=[{_LETTER}0-9])(?= [{_LETTER}0-9])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[{_WIDE}])(?=[、。！，？])")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, part_chars: int = PART_CHARS) -> Iterator[str]:
    """The text cut at the first safe boundary after every ``part_chars`` characters."""
    at = 0
    while len(text) - at > part_chars and (found := SAFE.search(text, at + part_chars)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def encode_text(enc: tiktoken.Encoding, text: str, part_chars: int = PART_CHARS) -> list[int]:
    if len(text) <= part_chars:
        return enc.encode_ordinary(text)
    return [i for part in safe_parts(text, part_chars) for i in enc.encode_ordinary(part)]


def decode_ids(enc: tiktoken.Encoding, ids: list[int]) -> bytes:
    return enc.decode_bytes(ids)


def encode(docs: DataFrame, rank_file: str | None = None, pattern: str | None = None, part_chars: int = PART_CHARS) -> DataFrame:
    """doc_id, ids (array of int) of every row; one narrow stage, no shuffle."""
    rank_file = rank_file or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern = pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            ids = [encode_text(enc, t or "", part_chars) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, bytes of every row of ``encode``'s shape; null ids decode to no bytes."""
    rank_file = rank_file or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern = pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            raw = [decode_ids(enc, x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(raw, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip_digests(docs: DataFrame, rank_file: str | None = None, pattern: str | None = None, part_chars: int = PART_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes: encode then decode in one pass.

    The ids never leave the Python worker, so nothing but digests is moved.
    """
    rank_file = rank_file or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern = pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            counts, digests, back, sizes = [], [], [], []
            for text in batch.column(1):
                ids = encode_text(enc, text.as_py() or "", part_chars)
                raw = decode_ids(enc, ids)
                counts.append(len(ids))
                digests.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                back.append(hashlib.sha256(raw).hexdigest())
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string()), pa.array(sizes, pa.int64())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip_digests(common.read_table(spark, sf_dir, "documents"))
