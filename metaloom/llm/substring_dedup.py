"""Exact substring dedup over word windows by super-k-mer partitioning.

A window is ``k`` consecutive words of one document.  Every word covered by a
window whose word sequence also starts earlier (smaller doc_id, or the same
document and an earlier start) is removed.

1. *Map.* Each word gets a content hash; each window the minimum of the hashes
   of its ``m``-word grams, its minimiser.  A maximal run of consecutive windows
   with one minimiser value is a super-k-mer.  Equal windows have equal
   minimisers, so they meet in the bucket ``minimiser mod buckets``; there a run
   goes as one packed slice of the text.  All runs that a slice of the corpus has
   for a bucket are one row, its columns delta-coded and the whole compressed under a
   dictionary of a few pieces of text (which makes small rows small and nothing
   else).  Runs equal to an earlier run of the same slice are duplicates already:
   they aren't sent, only their places are, spread over rows of their own, so that a
   passage that a third of all documents hold reaches its bucket once a slice, not
   once a document.
2. *Bucket.* Windows are ordered by their hash, then document and start; equal
   hashes are compared word by word, so a collision can't remove a word.  All
   windows of a group but its first start are duplicates.  A bucket of more than
   ``most_bytes`` (a minimiser that very many different runs share) is cut anew, by
   minimisers of longer grams, and judged in a further round; the last round's grams
   are whole windows.
3. *Apply.* The duplicate stretches meet their documents again by doc_id.

The number of buckets follows the size of the input, so a bucket's memory
doesn't; a task sorts its buckets and takes one after the other.  The hashes route
and order only; results are exact.

Defined results: null and empty texts have no words; a text of fewer than ``k``
words keeps all.  Where doc_ids repeat, a document is a doc_id with a text: rows of
both the same are the same windows, none removes the other's, and all lose what
starts earlier elsewhere; documents with one doc_id and different texts come in order
of the texts' MD5.  (Only then, rows carry 64 bits of that digest.)  A null doc_id
sorts before all others.  An empty table gives no rows.  Very long texts are cut in
runs like others, a slice of rows at a time.  Other columns pass ``apply_removals``
untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 20
GRAM = 3
#: Gram lengths of the rounds for buckets that are too large; at last whole windows.
FINER_GRAMS = (8, 14)
#: Bytes of text that a bucket is to hold, about; sets the number of buckets.
BUCKET_BYTES = 4 << 20
#: Bytes of packed runs beyond which a bucket is cut anew.
MOST_BYTES = 64 << 20
#: Bytes of text that are cut into runs at a time; bounds a Python worker's memory.
SLICE_BYTES = 8 << 20
#: Most tasks that the buckets are spread over.
MOST_TASKS = 1 << 16
#: Bytes of text that rows are compressed under.
DICTIONARY = 1 << 16
LEVEL = 6

_NULL_ID = -(1 << 63)
_HEAD = struct.Struct("<qqi")


class Packer:
    """Rows of runs, or of places alone, as compressed bytes.

    Columns are differences from run to run, byte plane by byte plane, so that what
    they have in common takes no room.
    """

    def __init__(self, dictionary: bytes = b""):
        known = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(dictionary) > 8 else None
        self._pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=known)
        self._unpack = zstandard.ZstdDecompressor(dict_data=known)

    def pack(self, columns: list[np.ndarray], text: bytes | None) -> bytes:
        planes = [np.diff(c.view(np.int64), prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns]
        head = _HEAD.pack(len(columns[0]), -1 if text is None else len(text), len(columns))
        return self._pack.compress(head + b"".join(planes) + (text or b""))

    def unpack(self, payload: bytes) -> tuple[list[np.ndarray], bytes | None]:
        body = self._unpack.decompress(payload)
        n, length, columns = _HEAD.unpack_from(body)
        planes = np.frombuffer(body, np.uint8, columns * 8 * n, _HEAD.size).reshape(columns, 8, n)
        found = [np.cumsum(np.ascontiguousarray(p.T).view(np.int64).ravel()) for p in planes]
        return found, None if length < 0 else body[len(body) - length :]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def window_minimisers(hashes: np.ndarray, k: int, m: int) -> np.ndarray:
    """The minimiser of every window of ``k`` words, over a whole batch."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    n = len(hashes) - m + 1
    grams = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(m):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    return sliding_min(common.mix(grams), k - m + 1)


def super_kmers(hashes: np.ndarray, first: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window's word, number of windows, minimiser) of each run; words of row r are first[r]:first[r + 1]."""
    lowest = window_minimisers(hashes, k, m)
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)
    fits = np.arange(len(lowest)) + k <= first[row[: len(lowest)] + 1]
    at = np.flatnonzero(fits)
    if len(at) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    low = lowest[at]
    new = np.concatenate(([True], (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])))
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(at)))
    return row[at[begin]], at[begin], size, low[begin]


def _pack_runs(keys: list[np.ndarray], raw: bytes, begin: np.ndarray, end: np.ndarray, place: np.ndarray, size: np.ndarray, low: np.ndarray, buckets: int, packer: Packer) -> Iterator[tuple[int, bytes]]:
    """Rows (bucket, payload) of runs raw[begin:end], whose documents ``keys`` (one or two columns) tell apart."""
    bucket = (low % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((place, *reversed(keys), bucket))
    bucket = bucket[order]
    begin, end = begin.tolist(), end.tolist()
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    known, first = [], []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        slices: dict[bytes, int] = {}
        kept = []
        for i in order[a:b].tolist():
            piece = raw[begin[i] : end[i]]
            had = slices.setdefault(piece, i)
            if had == i:
                kept.append(i)
            else:
                known.append(i)
                first.append(had)
        head = np.array(kept)
        yield int(bucket[a]), packer.pack([*(k[head] for k in keys), place[head], size[head]], b"\n".join(slices))
    if known:
        known, first = np.array(known), np.array(first)
        # the same document's same place is no duplicate
        known = known[np.any([c[known] != c[first] for c in (*keys, place)], axis=0)]
        if len(known):
            yield int((keys[0][known[0]] ^ place[known[0]]) % buckets), packer.pack([*(k[known] for k in keys), place[known], size[known]], None)


def _map_runs(keys: list[np.ndarray], data: np.ndarray, offsets: np.ndarray, buckets: int, k: int, m: int, packer: Packer) -> Iterator[tuple[int, bytes]]:
    """Rows (bucket, payload) of a slice of rows."""
    starts, ends, first = common.word_bounds(~common.IS_WHITE[data], offsets)
    hashes = common.word_hashes(data, starts, ends)
    row, word, size, low = super_kmers(hashes, first, k, m)
    if len(row):
        yield from _pack_runs([c[row] for c in keys], data.tobytes(), starts[word], ends[word + size + k - 2], word - first[row], size, low, buckets, packer)


def _finer_runs(payload: bytes, k: int, m: int, packer: Packer) -> Iterator[tuple[int, bytes]]:
    """The runs of a row cut anew, by minimisers of ``m`` words, for buckets without number."""
    (*keys, place, size), text = packer.unpack(payload)
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = common.word_bounds(~common.IS_WHITE[data], np.array([0, len(data)]))
    first = np.concatenate(([0], np.cumsum(size + k - 1)))
    row, word, inner, low = super_kmers(common.word_hashes(data, starts, ends), first, k, m)
    yield from _pack_runs([c[row] for c in keys], text, starts[word], ends[word + inner + k - 2], place[row] + word - first[row], inner, low, 1 << 62, packer)


def _duplicates(payloads: list[bytes], k: int, packer: Packer) -> list[np.ndarray]:
    """Columns (keys, start, windows) of the stretches of a bucket's windows that start earlier elsewhere."""
    runs, texts, known = [], [], []
    for payload in payloads:
        columns, text = packer.unpack(payload)
        (known if text is None else runs).append(columns)
        if text is not None:
            texts.append(text)
    found = known
    if runs:
        *keys, place, size = (np.concatenate(c) for c in zip(*runs))
        found = [*known, _bucket_duplicates(keys, place, size, b"\n".join(texts), k)]
    return [np.concatenate(c) for c in zip(*found)]


def _bucket_duplicates(keys: list[np.ndarray], place: np.ndarray, size: np.ndarray, text: bytes, k: int) -> list[np.ndarray]:
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = common.word_bounds(~common.IS_WHITE[data], np.array([0, len(data)]))
    hashes = common.word_hashes(data, starts, ends)
    words = size + k - 1
    run_word = np.concatenate(([0], np.cumsum(words)[:-1]))
    # every window: its run, its first word, its start in the document
    run = np.repeat(np.arange(len(size)), size)
    inner = np.arange(len(run)) - np.repeat(np.concatenate(([0], np.cumsum(size)[:-1])), size)
    word = run_word[run] + inner
    start = place[run] + inner
    with np.errstate(over="ignore"):
        value = np.zeros(len(word), np.uint64)
        for j in range(k):
            value = value * np.uint64(0xD6E8FEB86659FD93) + hashes[word + j]
    value = common.mix(value)
    order = np.argsort(value, kind="stable")
    ranked = value[order]
    same = np.concatenate(([False], ranked[1:] == ranked[:-1]))
    shared = same | np.concatenate((same[1:], [False]))
    order, ranked = order[shared], ranked[shared]
    if len(order) == 0:
        return [np.zeros(0, np.int64)] * (len(keys) + 2)
    fine = np.lexsort((start[order], *(c[run[order]] for c in reversed(keys)), ranked))
    order, ranked = order[fine], ranked[fine]
    lead = np.maximum.accumulate(np.where(np.concatenate(([True], ranked[1:] != ranked[:-1])), np.arange(len(order)), 0))
    leader = order[lead]
    equal = _equal_windows(text, starts, ends, word[leader], word[order], k)
    later = np.any([*(c[run[order]] != c[run[leader]] for c in keys), start[order] != start[leader]], axis=0)
    duplicate = np.zeros(len(run), dtype=bool)
    duplicate[order[equal & later]] = True
    if not equal.all():
        _settle_collisions(text, starts, ends, word, [c[run] for c in keys], start, order, ranked, k, duplicate)
    at = np.flatnonzero(duplicate)
    new = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (run[at[1:]] != run[at[:-1]])))
    begin = np.flatnonzero(new)
    return [*(c[run[at[begin]]] for c in keys), start[at[begin]], np.diff(np.append(begin, len(at)))]


def _window_words(text: bytes, starts: np.ndarray, ends: np.ndarray, word: int, k: int) -> tuple[bytes, ...]:
    return tuple(text[starts[word] : ends[word + k - 1]].split())


def _equal_windows(text: bytes, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Whether the windows at words a and b hold the same words, compared as text."""
    out = np.ones(len(a), dtype=bool)
    sa, ea, sb, eb = (x.tolist() for x in (starts[a], ends[a + k - 1], starts[b], ends[b + k - 1]))
    for i in np.flatnonzero(a != b).tolist():
        x, y = text[sa[i] : ea[i]], text[sb[i] : eb[i]]
        if x != y and x.split() != y.split():
            out[i] = False
    return out


def _settle_collisions(text, starts, ends, word, keys, start, order, ranked, k, duplicate) -> None:
    """Judge the windows of hash groups with unequal members by their words alone."""
    cuts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1], [True])))
    for a, b in zip(cuts[:-1], cuts[1:]):
        first: dict[tuple[bytes, ...], int] = {}
        for i in order[a:b]:
            had = first.setdefault(_window_words(text, starts, ends, word[i], k), i)
            duplicate[i] = any(c[had] != c[i] for c in (*keys, start))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())


def _survey(docs: DataFrame) -> tuple[int, bool]:
    """(bytes of text, whether a doc_id repeats)."""
    sizes = docs.select(F.col("doc_id").cast("long").alias("id"), F.octet_length("text").alias("n"))
    each = sizes.groupBy("id").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    found = each.agg(F.sum("n").alias("n"), F.max("rows").alias("rows")).first()
    return found["n"] or 0, (found["rows"] or 0) > 1


def _dictionary(docs: DataFrame) -> bytes:
    """A few pieces of text, to compress rows under."""
    rows = docs.select(F.substring("row.text", 1, 2048).alias("t")).where("t <> ''").limit(DICTIONARY // 1024).collect()
    return "\n".join(r["t"] for r in rows).encode()[:DICTIONARY]


def _keyed(docs: DataFrame, repeats: bool) -> DataFrame:
    """id (never null), tag (what tells texts of one doc_id apart; null where no doc_id repeats), and ``docs`` as a struct ``row``."""
    tag = F.conv(F.substring(F.md5(common.text_column(docs)), 1, 16), 16, -10).cast("long") if repeats else F.lit(None).cast("long")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("id"), tag.alias("tag"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))


def _stretches(keyed: DataFrame, size: int, repeats: bool, k: int, m: int, bucket_bytes: int, most_bytes: int) -> DataFrame:
    """id, tag, stretches (array of (start, windows)): the duplicate windows of every document that has any."""
    buckets = max(1, -(-size // bucket_bytes))
    shared = keyed.sparkSession.sparkContext.broadcast(_dictionary(keyed))
    names = ["id", "tag", "start", "windows"] if repeats else ["id", "start", "windows"]

    def packed_rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "payload"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(shared.value)
        for batch in batches:
            keys = [batch.column(0).to_numpy()]
            if repeats:
                # as the digest's order: without a sign
                keys.append(batch.column(1).to_numpy() ^ np.int64(-1 << 63))
            data, offsets = common.string_buffers(batch.column(2))
            for a, b in common.slices(offsets, SLICE_BYTES):
                yield packed_rows(list(_map_runs([c[a:b] for c in keys], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], buckets, k, m, packer)))

    def judge(finer: int | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # rows come sorted by bucket
            packer = Packer(shared.value)
            for _, rows in groupby(_rows(batches), key=itemgetter(0)):
                held, again, size = [], [], 0
                for _, payload in rows:
                    if finer is not None:
                        size += zstandard.frame_content_size(payload)
                    if size <= most_bytes:
                        held.append(payload)
                        continue
                    # too large: places are places, runs go on to smaller buckets
                    for other in [*held, payload]:
                        if packer.unpack(other)[1] is None:
                            yield result([other], packer)
                        else:
                            again += _finer_runs(other, k, finer, packer)
                    held = []
                    while again:
                        yield pa.RecordBatch.from_arrays([*(pa.nulls(min(1000, len(again)), pa.int64()) for _ in names), *packed_rows(again[:1000]).columns], [*names, "bucket", "payload"])
                        del again[:1000]
                if held:
                    yield result(held, packer)

        return run

    def result(payloads: list[bytes], packer: Packer) -> pa.RecordBatch:
        columns = _duplicates(payloads, k, packer)
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], [*names, "bucket", "payload"])

    packed = keyed.select("id", "tag", F.coalesce("row.text", F.lit("")).alias("text")).mapInArrow(pack, "bucket long, payload binary")
    schema = ", ".join(f"{c} long" for c in names) + ", bucket long, payload binary"
    tasks = min(MOST_TASKS, buckets)
    judged: DataFrame | None = None
    for finer in [*(g for g in FINER_GRAMS if m < g < k), k, None] if m < k else [None]:
        # a task for each bucket while they are few: hashing buckets to tasks would give some tasks several
        placed = packed.repartitionById(tasks, F.pmod("bucket", F.lit(tasks)).cast("int")).sortWithinPartitions("bucket")
        done = common.materialize(placed.mapInArrow(judge(finer), schema), "stretches")
        found = done.where("payload is null").select(*names)
        judged = found if judged is None else judged.unionAll(found)
        packed = done.where("payload is not null").select("bucket", "payload")
        if finer is None or packed.isEmpty():
            break
    tag = F.col("tag").bitwiseXOR(F.lit(_NULL_ID)) if repeats else F.lit(None).cast("long")
    marks = judged.select("id", tag.alias("tag"), F.struct("start", "windows").alias("stretch"))
    # copies of a row have the same stretches
    return marks.groupBy("id", "tag").agg((F.collect_set if repeats else F.collect_list)("stretch").alias("stretches"))


def kept_words(text: bytes, stretches, k: int) -> tuple[int, list[bytes]]:
    words = text.split()
    if not stretches:
        return len(words), words
    gone = np.zeros(len(words) + 1, np.int32)
    for s in stretches:
        gone[s["start"]] += 1
        gone[s["start"] + s["windows"] + k - 1] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    return len(words), [w for w, stays in zip(words, keep.tolist()) if stays]


def _with_stretches(docs: DataFrame, k: int = WINDOW, m: int = GRAM, bucket_bytes: int = BUCKET_BYTES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """text, stretches (its duplicate windows), and ``docs`` as one struct column ``row``."""
    size, repeats = _survey(docs)
    keyed = _keyed(docs, repeats)
    marks = _stretches(keyed, size, repeats, k, m, bucket_bytes, most_bytes)
    names = ["id", "tag"] if repeats else ["id"]
    return keyed.join(marks.select(*names, "stretches"), names, "left").select(F.col("row.text").alias("text"), "stretches", "row")


def apply_removals(docs: DataFrame, k: int = WINDOW, **options) -> DataFrame:
    """The rows of ``docs``, all columns; a text that loses words becomes its kept words joined by one space, others stay as they are."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, stretches in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is None or not stretches:
                    texts.append(text)
                    continue
                n, words = kept_words(text.encode(), stretches, k)
                texts.append(text if len(words) == n else b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(2)], ["text", "row"])

    rows = _with_stretches(docs, k=k, **options)
    schema = rows.drop("stretches").schema
    done = rows.mapInArrow(cut, schema)
    return done.select(*[F.col("text").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def removal_digests(docs: DataFrame, k: int = WINDOW, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, digests = [], [], []
            for text, stretches in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                n, words = kept_words((text or "").encode(), stretches, k)
                total.append(n)
                removed.append(n - len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    slim = docs.select("doc_id", "text")
    rows = _with_stretches(slim, k=k, **options).select(F.col("row.doc_id").cast("long").alias("doc_id"), "text", "stretches")
    return rows.mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return removal_digests(common.read_table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, md5(coalesce(text, '')) AS tag,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
),
starts AS (SELECT r, doc_id, tag, ws, unnest(range(1, len(ws) - 18)) AS s FROM words WHERE len(ws) >= 20),
windows AS (SELECT r, doc_id, tag, s, array_to_string(ws[s:s + 19], ' ') AS seq FROM starts),
later AS (SELECT r, s FROM (SELECT r, s, rank() OVER (PARTITION BY seq ORDER BY doc_id NULLS FIRST, tag, s) AS nth FROM windows) WHERE nth > 1),
gone AS (SELECT DISTINCT r, unnest(range(s, s + 20)) AS p FROM later),
each AS (SELECT r, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS w FROM words),
marked AS (SELECT e.r, e.p, e.w, g.p IS NOT NULL AS cut FROM each e LEFT JOIN gone g ON e.r = g.r AND e.p = g.p),
kept AS (SELECT r, count(*) AS n, count(*) FILTER (cut) AS n_cut, string_agg(w, ' ' ORDER BY p) FILTER (NOT cut) AS t FROM marked GROUP BY r)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(n_cut, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words d LEFT JOIN kept k ON d.r = k.r
"""
