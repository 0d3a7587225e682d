"""SpotSigs fingerprints and their pruned Jaccard comparison.

A *spot* is an occurrence of a common word (an anchor); its signature is the
anchor with the chain of the next ``chain`` content words, i.e. words that aren't
anchors.  A text's fingerprint is the sorted set of its signatures' 64-bit hashes,
16 hex digits each.  A text without a spot has one signature, of all its words
in order, so that only texts of the same words share it; a text without words has
the empty fingerprint.

Words are maximal runs of digits, ASCII letters (lower-cased) and non-ASCII
characters.  Anchors are the commonest function words of several languages, a
parameter.

Two texts are compared by the Jaccard likeness of their sets, pruned by their lengths:
of sets of a and b signatures the likeness is at most min / max, so an empty set, or two
whose ranges of hashes don't meet, are never merged; the others are merged in partitions of
like length.  ``similar`` finds all pairs with a likeness of at least ``threshold``: sets
are partitioned by length, in classes that grow by 1 / threshold, so that a set meets
only its own class and the next; within those a pair meets at the rarest signatures of its
prefix (a set of n signatures needs n - ceil(threshold * n) + 1 of them, so no pair is
lost), and a candidate is verified by a merge that stops when the bound can't be met.

Documents are put in order of doc_id by one shuffle of their texts to ranges of doc_id, an id
of many rows being several ranges by a hash of the text; the first text of each range goes
to the range before it as well.

Defined results: null texts are empty; equal texts have equal fingerprints and
likeness 1; two empty fingerprints are alike (1), an empty and another are not
(0); repeated rows are rows of their own; rows with equal doc_id are ordered by a hash
of their texts, a null doc_id comes before all others; an empty table gives no rows; a
very long text is signed whole, by itself; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

ANCHORS = tuple(
    "the a an of to in on at is are was be by for and or with from that this it as his her not have "
    "le la les de des du un une et en est que qui dans pour par sur au "
    "der die das und ein eine den dem zu von mit ist im auf nicht "
    "el los las y que del se por con una para como es".split()
)
CHAIN = 2
_NULL_ID = -(1 << 63)
#: Ranges of doc_id for each shuffle partition, so that partitions get about the same.
SLICES_A_PARTITION = 4
#: Bytes of text signed at a time; bounds a Python worker's memory.
SLICE_BYTES = 4 << 20


def _hash_words(words: list[bytes]) -> np.ndarray:
    raw = b" ".join(words)
    data = np.frombuffer(raw, np.uint8)
    starts, ends, _ = common.word_bounds(data != 32, np.array([0, len(data)]))
    return common.word_hashes(data, starts, ends)


@dataclass
class Sets:
    """The sorted distinct signatures of every row of a batch; those of row r are sigs[cuts[r]:cuts[r + 1]]."""

    cuts: np.ndarray
    sigs: np.ndarray

    def rows(self, a: int, b: int) -> Sets:
        return Sets(self.cuts[a : b + 1] - self.cuts[a], self.sigs[self.cuts[a] : self.cuts[b]])


def signatures(data: np.ndarray, offsets: np.ndarray, anchors: np.ndarray, chain: int = CHAIN) -> Sets:
    data = common.lower_ascii(data)
    starts, ends, first = common.word_bounds(common.IS_ALNUM[data], offsets)
    hashes = common.word_hashes(data, starts, ends)
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)
    is_anchor = np.isin(hashes, anchors)
    content = np.flatnonzero(~is_anchor)
    spots = np.flatnonzero(is_anchor)
    following = np.searchsorted(content, spots)
    fits = following + chain <= len(content)
    spots, following = spots[fits], following[fits]
    if len(spots):
        same = row[content[following + chain - 1]] == row[spots]
        spots, following = spots[same], following[same]
    with np.errstate(over="ignore"):
        value = hashes[spots].copy()
        for j in range(chain):
            value = value * np.uint64(0x9E3779B97F4A7C15) + hashes[content[following + j]]
    owner, value = row[spots], common.mix(value)
    bare = np.setdiff1d(np.flatnonzero(counts), owner)
    if len(bare):
        # the whole sequence
        whole = [int.from_bytes(hashlib.blake2b(hashes[first[r] : first[r + 1]].tobytes(), digest_size=8).digest(), "big") for r in bare.tolist()]
        owner, value = np.concatenate((owner, bare)), np.concatenate((value, np.array(whole, np.uint64)))
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return Sets(np.searchsorted(owner[new], np.arange(len(counts) + 1)), value[new])


def serialise(sets: Sets) -> list[str]:
    """The fingerprint of every row."""
    cuts = sets.cuts.tolist()
    hexes = sets.sigs.astype(">u8").tobytes().hex()
    return [hexes[16 * a : 16 * b] for a, b in zip(cuts, cuts[1:])]


def likeness(a: Sets, b: Sets) -> np.ndarray:
    """Jaccard likeness of each row's two sets; two empty ones are alike."""
    na, nb = np.diff(a.cuts), np.diff(b.cuts)
    out = np.where(na + nb == 0, 1.0, 0.0)
    rows = np.flatnonzero((na > 0) & (nb > 0))
    # pruned: ranges that don't meet
    rows = rows[(a.sigs[a.cuts[rows]] <= b.sigs[b.cuts[rows + 1] - 1]) & (b.sigs[b.cuts[rows]] <= a.sigs[a.cuts[rows + 1] - 1])]
    # partitions of like length
    size = np.maximum(na, nb)[rows]
    for least in np.unique(np.int64(1) << np.frexp(size.astype(float))[1]).tolist():
        some = rows[(size < least) & (2 * size >= least)]
        owner = np.concatenate([np.repeat(some, n[some]) for n in (na, nb)])
        place = np.concatenate([np.repeat(s.cuts[some] - np.cumsum(n[some]) + n[some], n[some]) + np.arange(n[some].sum()) for s, n in ((a, na), (b, nb))])
        value = np.concatenate((a.sigs[place[: na[some].sum()]], b.sigs[place[na[some].sum() :]]))
        order = np.lexsort((value, owner))
        owner, value = owner[order], value[order]
        twice = (owner[1:] == owner[:-1]) & (value[1:] == value[:-1])
        shared = np.bincount(owner[1:][twice], minlength=len(na))[some]
        out[some] = shared / (na[some] + nb[some] - shared)
    return out


def _encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return common.string_buffers(pa.array(texts, pa.large_string()))


def edit(text: str, following: str) -> str:
    """The text, its last floor(n / 2) characters replaced by as many of the next text's first, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """slice, doc_id, digest, text, extra: every range of rows, followed (extra) by the first row of the next."""
    ranges = ranges or SLICES_A_PARTITION * max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("id"), common.text_column(docs).alias("text"))
    cuts = rows.select(F.percentile_approx("id", F.lit([i / ranges for i in range(1, ranges)] or [0.5]), F.lit(10000)).alias("cuts")).first()["cuts"] or []
    times = Counter(float(c) for c in cuts) if ranges > 1 else {}
    # an id at several cuts is a range by itself
    splits = sorted({x for c, n in times.items() for x in ((c, math.nextafter(c, math.inf)) if n > 1 else (c,))})
    by_range = Bucketizer(splits=[-math.inf, *(splits or [0.0]), math.inf], inputCol="as_double", outputCol="range").transform(rows.withColumn("as_double", F.col("id").cast("double")))
    by_range = by_range.withColumn("range", F.col("range").cast("long"))
    parts = F.lit(1)
    many = {bisect.bisect_right(splits, c): n for c, n in times.items() if n > 1}
    if many:
        # at most a row for two cuts
        single = by_range.where(F.col("range").isin(list(many))).groupBy("range").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a = b").collect()
        for r in single:
            parts = F.when(F.col("range") == r["range"], F.lit(many[r["range"]])).otherwise(parts)
    digest = F.xxhash64("text")
    part = F.least(F.floor((digest / F.lit(2.0**64) + 0.5) * parts).cast("long"), parts - 1)
    placed = by_range.select((F.col("range") * ranges + F.when(parts > 1, part).otherwise(F.lit(0))).alias("slice"), "id", digest.alias("digest"), "text")
    heads = placed.groupBy("slice").agg(F.min(F.struct("id", "digest")).alias("head"))
    around = Window.orderBy("slice")
    last = F.max("slice").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # a row for each range
    heads = heads.select(F.coalesce(F.lag("slice").over(around), last).alias("before"), F.col("head.id").alias("head_id"), F.col("head.digest").alias("head_digest"))
    found = placed.join(F.broadcast(heads), (F.col("id") == F.col("head_id")) & (F.col("digest") == F.col("head_digest")))
    extra = found.groupBy("before").agg(F.first("id").alias("id"), F.first("digest").alias("digest"), F.first("text").alias("text")).withColumnRenamed("before", "slice")
    return placed.withColumn("extra", F.lit(False)).unionByName(extra.withColumn("extra", F.lit(True)))


def edited_fingerprints(docs: DataFrame, anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    common.bound_batches(docs.sparkSession)
    anchor_hashes = np.sort(_hash_words([a.encode() for a in anchors]))
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def signed(rows: list[tuple[int, str]], last: str) -> pa.RecordBatch:
        """The results of consecutive rows, the last of which is followed by ``last``."""
        texts = [t for _, t in rows]
        edited = [edit(a, b) for a, b in zip(texts, [*texts[1:], last])]
        n = len(rows)
        sets, changed = signatures(*_encode([*texts, last]), anchor_hashes, chain), signatures(*_encode(edited), anchor_hashes, chain)
        own, after = sets.rows(0, n), sets.rows(1, n + 1)
        values = (
            pa.array([None if i == _NULL_ID else i for i, _ in rows], pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array(serialise(own), pa.string()),
            pa.array(serialise(changed), pa.string()),
            pa.array(likeness(own, changed), pa.float64()),
            pa.array(likeness(own, after), pa.float64()),
        )
        return pa.RecordBatch.from_arrays(list(values), columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by slice, the extra row last in its slice
        pending: list[tuple[int, str]] = []
        held = 0
        for batch in batches:
            for doc_id, text, extra in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                text = text.as_py()
                if pending and (extra or held > SLICE_BYTES):
                    yield signed(pending, text)
                    pending, held = [], 0
                if not extra:
                    pending.append((doc_id, text))
                    held += len(text)

    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = with_next(docs, ranges).repartition(n, "slice").sortWithinPartitions("slice", "extra", "id", "digest")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.select("id", "text", "extra").mapInArrow(run, schema)


def signature_sets(docs: DataFrame, anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """doc_id, sigs (sorted distinct hashes) of every row; no shuffle."""
    anchor_hashes = np.sort(_hash_words([a.encode() for a in anchors]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.string_buffers(batch.column(1))
            for a, b in common.slices(offsets, SLICE_BYTES):
                sets = signatures(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], anchor_hashes, chain)
                sigs = pa.ListArray.from_arrays(pa.array(sets.cuts, pa.int32()), pa.array((sets.sigs ^ np.uint64(1 << 63)).view(np.int64)))  # signed, in the same order
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), sigs], ["doc_id", "sigs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column(docs).alias("text")).mapInArrow(run, "doc_id long, sigs array<long>")


def jaccard_at_least(a: list[int], b: list[int], threshold: float) -> float | None:
    """Jaccard likeness of two sorted sets; None as soon as it can't reach the threshold."""
    if not a and not b:
        return 1.0
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return None
    i = j = shared = 0
    need = threshold * (len(a) + len(b)) / (1 + threshold) - 1e-9
    while i < len(a) and j < len(b):
        if shared + min(len(a) - i, len(b) - j) < need:
            return None
        if a[i] == b[j]:
            shared, i, j = shared + 1, i + 1, j + 1
        elif a[i] < b[j]:
            i = bisect.bisect_left(a, b[j], i)
        else:
            j = bisect.bisect_left(b, a[i], j)
    return shared / (len(a) + len(b) - shared) if shared >= need else None


def similar(docs: DataFrame, threshold: float = 0.7, **options) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members has doc_id and set_id (the smallest doc_id with the same set);
    pairs has a < b (set_ids of different sets) and likeness >= threshold.

    Equal sets are one class before anything is compared.
    """
    sets = common.materialize(signature_sets(docs, **options).withColumn("key", F.sha2(F.concat_ws(",", F.col("sigs").cast("array<string>")), 256)), "sigs")
    classes = sets.groupBy("key").agg(F.min(F.coalesce("doc_id", F.lit(_NULL_ID))).alias("set_id"), F.any_value("sigs").alias("sigs"))
    classes = common.materialize(classes, "sets")
    members = sets.join(classes.select("key", "set_id"), "key").select("doc_id", F.nullif("set_id", F.lit(_NULL_ID)).alias("set_id"))
    weights = classes.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count("*").alias("df"))
    listed = classes.select("set_id", F.size("sigs").alias("n"), F.explode("sigs").alias("sig")).join(weights, "sig")
    ranked = listed.groupBy("set_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("by_df"))
    prefix = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - F.lit(1e-9)) + 1
    heads = ranked.select("set_id", "n", F.explode(F.slice("by_df", F.lit(1), prefix.cast("int"))).alias("head")).select("set_id", "n", F.col("head.sig").alias("sig"))
    # classes of length: the larger of a pair is of the smaller's class or the next
    step = math.log(1 / threshold) if 0 < threshold < 1 else 1.0
    of_length = F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) / step + 1e-9)
    smaller = heads.select("set_id", "n", "sig", F.explode(F.array(of_length, of_length + 1)).alias("class"))
    larger = heads.select(F.col("set_id").alias("other"), F.col("n").alias("m"), "sig", of_length.alias("class"))
    close = (F.col("n") >= F.lit(threshold) * F.col("m")) & ((F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("set_id") < F.col("other"))))
    candidates = smaller.join(larger, ["class", "sig"]).where(close).select(F.least("set_id", "other").alias("a"), F.greatest("set_id", "other").alias("b")).distinct()
    sized = classes.select("set_id", "sigs")
    both = candidates.join(sized.select(F.col("set_id").alias("a"), F.col("sigs").alias("sa")), "a").join(sized.select(F.col("set_id").alias("b"), F.col("sigs").alias("sb")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(a, b, s) for a, b, x, y in zip(*(batch.column(i).to_pylist() for i in range(4))) if (s := jaccard_at_least(x, y, threshold)) is not None]
            a, b, s = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], ["a", "b", "likeness"])

    return members, both.select("a", "b", "sa", "sb").mapInArrow(verify, "a long, b long, likeness double")


def op8_spotsigs(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(common.read_table(spark, sf_dir, "documents"))
