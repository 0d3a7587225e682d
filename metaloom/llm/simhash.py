"""SimHash near-duplicate groups by vantage-point trees over Hamming space.

*Fingerprints.* Lower-cased (A-Z) words, 2-word shingles with repeats, XXH64 with
seed 42; a bit is 1 if it is set in more than half of the hashes.  Fewer words
than two: the whole sequence is the only shingle; no word: fingerprint zero.

*Classes.* Equal fingerprints are one class, counted before anything is compared;
its node is the fingerprint, as doc_ids may repeat or be null.  Copies are never expanded into pairs.

*Forest.* All pairs of classes within ``radius`` bits are found exactly.  The 64
bits are cut into ``blocks`` blocks; two fingerprints within 6 bits differ by at
most 6 // 4 = 1 bit in one of 4 blocks (pigeonhole), so each block has a tree of
its own, whose metric is the Hamming distance within the block and whose search
radius is 1.  (One tree over all 64 bits can't prune: fingerprints lie about 32 ± 4
bits from any vantage point, so a shell 6 bits wide holds nearly half of them.)
An inner node has a vantage point v and a radius r: d(x, v) <= r is inside.  By the
triangle inequality a partner of an outside point within the search radius s can
only be inside if d(x, v) <= r + s; such boundary points are sent to the inside
shard too, as visitors, and a visitor goes down every branch its ball touches.
So each pair meets exactly once in a tree; a pair that an earlier tree already
finds is left to it.

The upper levels, which make the shards, are fitted on a bounded sample of the
fingerprints (``SAMPLE``, balance only: any tree gives the same pairs); a shard
goes on splitting by vantage points of its own until ``LEAF`` points are left,
which are compared by xor and bit count.

*Links and groups.* A shard returns a count of linked rows for each fingerprint
and the spanning forest of its links (never all pairs of a group); groups are the
connected components, by alternating large-star and small-star rounds over tables
in the shared folder.

Defined results: null and empty texts have fingerprint zero and link like others;
repeated rows are counted as rows (``n_near`` counts the *other rows* linked
directly); a null doc_id counts as the smallest id and is returned as null; rows
with null or equal doc_ids are linked by their texts alone; an empty table gives no rows; other columns are ignored in ``near_duplicates`` and kept
in ``keep_representatives``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components

RADIUS = 6
BLOCKS = 4
#: Fingerprints that the shards' trees are fitted on (balance only): so many, or
#: ``SAMPLE_A_SHARD`` for each shard if that is more, up to ``MOST_SAMPLE`` (8 MB).
SAMPLE, SAMPLE_A_SHARD, MOST_SAMPLE = 16384, 64, 1 << 20
#: Fingerprints that a shard is to hold, about.
SHARD = 16384
#: Most tasks that shards are spread over.
MOST_TASKS = 10_000
#: Points that are compared directly.
LEAF = 384

U64 = np.uint64


def fingerprint_text(text: str) -> int:
    """The fingerprint of one text, as an unsigned integer."""
    return int(_fingerprint(text.encode()))


def _fingerprint(raw: bytes) -> np.uint64:
    words = raw.lower().split()
    if not words:
        return U64(0)
    shingles = map(b" ".join, zip(words, words[1:])) if len(words) > 1 else words
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, 42) for s in shingles], U64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view(U64)[0]


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id (long), fp (long, the fingerprint's bits) and the columns ``more`` of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.string_buffers(batch.column(1))
            raw, cuts = data.tobytes(), offsets.tolist()
            found = np.array([_fingerprint(raw[a:b]) for a, b in zip(cuts, cuts[1:])], U64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64), pa.int64()), *batch.columns[2:]], ["doc_id", "fp", *more])

    taken = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column(docs).alias("text"), *more)
    return taken.mapInArrow(run, ", ".join(("doc_id long, fp long", *(f"{c} {docs.schema[c].dataType.simpleString()}" for c in more))))


@dataclass(frozen=True)
class Node:
    vantage: int
    radius: int
    inside: Node | int
    outside: Node | int


def block_masks(bits: int, blocks: int) -> list[int]:
    """``blocks`` masks that share out the set bits of ``bits`` in order."""
    places = [i for i in range(64) if bits >> i & 1]
    size = -(-len(places) // blocks)
    return [sum(1 << i for i in places[a : a + size]) for a in range(0, len(places), size)]


def _distance(points: np.ndarray, vantage: int, mask: int) -> np.ndarray:
    return np.bitwise_count((points ^ U64(vantage)) & U64(mask))


def choose(points: np.ndarray, mask: int, search: int) -> tuple[int, int, float]:
    """(vantage, radius, work left as a share) of the best of a few vantage points.

    The work of a split is the product of homes and points seen, over both sides.
    """
    best = (0, 0, 1.0)
    step = max(1, len(points) // 8)
    for vantage in np.unique(points[::step][:8]).tolist():
        seen = np.bincount(_distance(points, vantage, mask), minlength=66) / len(points)
        within = np.cumsum(seen)
        for r in range(int(mask).bit_count()):
            inner, outer = within[r], 1 - within[r]
            work = inner * within[min(65, r + search)] + outer * outer
            if work < best[2]:
                best = (vantage, r, work)
    return best


def grow(points: np.ndarray, mask: int, search: int, most: float) -> Node | int:
    """A tree of ``mask``'s block whose leaves hold at most ``most`` of the sample, if they can be split."""
    leaves = iter(range(1 << 30))

    def part(x: np.ndarray) -> Node | int:
        if len(x) <= most:
            return next(leaves)
        vantage, radius, work = choose(x, mask, search)
        if work > 0.95:
            return next(leaves)
        inside = _distance(x, vantage, mask) <= radius
        return Node(vantage, radius, part(x[inside]), part(x[~inside]))

    return part(points)


def leaf_count(tree: Node | int) -> int:
    return 1 if isinstance(tree, int) else leaf_count(tree.inside) + leaf_count(tree.outside)


def _split(d: np.ndarray, home: np.ndarray, radius: int, search: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(taken inside, home there, taken outside, home there) of points at distances ``d``."""
    inner = home & (d <= radius)
    outer = home & (d > radius)
    return inner | (d <= radius + search) & ~inner, inner, outer | (d + search > radius) & ~home, outer


def route(tree: Node | int, points: np.ndarray, mask: int, search: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, indices, home) of the points that each leaf takes."""
    work = [(tree, np.arange(len(points)), np.ones(len(points), dtype=bool))]
    while work:
        node, at, home = work.pop()
        if len(at) == 0:
            continue
        if isinstance(node, int):
            yield node, at, home
            continue
        i, hi, o, ho = _split(_distance(points[at], node.vantage, mask).astype(np.int64), home, node.radius, search)
        work += [(node.inside, at[i], hi[i]), (node.outside, at[o], ho[o])]


def _compare(points: np.ndarray, at: np.ndarray, home: np.ndarray, radius: int, rules: list[tuple[int, int, bool]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a leaf with a home point: home with home once, home with each visitor; in blocks."""
    order = np.concatenate((at[home], at[~home]))
    homes = int(home.sum())
    x = points[order]
    for low in range(0, homes, 1024):
        high = min(homes, low + 1024)
        for a in range(low, len(x), 8192):
            part = x[a : a + 8192]
            i, j = np.nonzero(np.bitwise_count(x[low:high, None] ^ part[None, :]) <= radius)
            i, j = i + low, j + a
            ahead = j > i
            i, j = i[ahead], j[ahead]
            if len(i) == 0:
                continue
            differing = x[i] ^ x[j]
            good = np.ones(len(i), dtype=bool)
            for mask, search, near in rules:
                good &= (np.bitwise_count(differing & U64(mask)) <= search) == near
            yield order[i[good]], order[j[good]]


def find_pairs(points: np.ndarray, home: np.ndarray, mask: int, search: int, radius: int, rules: list[tuple[int, int, bool]], free: int, leaf: int = LEAF) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within ``radius`` that obey ``rules``, each once, at least one of them home.

    ``mask``/``search`` are the metric's block and search radius, ``free`` the bits
    of no block yet: a shard that its block can't split goes on by blocks of those.
    """
    work = [(np.arange(len(points)), home)]
    while work:
        at, own = work.pop()
        if not own.any() or len(at) < 2:
            continue
        if len(at) > leaf:
            vantage, r, _ = choose(points[at[:: max(1, len(at) // 2048)]], mask, search)
            i, hi, o, ho = _split(_distance(points[at], vantage, mask).astype(np.int64), own, r, search)
            if hi.sum() * i.sum() + ho.sum() * o.sum() <= 0.95 * own.sum() * len(at):
                work += [(at[i], hi[i]), (at[o], ho[o])]
                continue
            if len(at) > 4 * leaf and free.bit_count() >= 4 * BLOCKS:
                parts = block_masks(free, BLOCKS)
                reach = radius // len(parts)
                for k, part in enumerate(parts):
                    inner = [*rules, *((m, reach, False) for m in parts[:k]), (part, reach, True)]
                    for a, b in find_pairs(points[at], own, part, reach, radius, inner, free & ~part, leaf):
                        yield at[a], at[b]
                continue
        yield from _compare(points, at, own, radius, rules)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable of each of ``n`` points."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (jumped := new[new]).tolist() != new.tolist():
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new


def shard_links(fp: np.ndarray, size: np.ndarray, home: np.ndarray, masks: list[int], tree: int, radius: int, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, linked rows, smallest linked fingerprint here) of the points of a shard that have links."""
    search = radius // len(masks)
    rules = [*((m, search, False) for m in masks[:tree]), (masks[tree], search, True)]
    order = np.argsort(fp, kind="stable")
    fp, size, home = fp[order], size[order], home[order]
    points, near, label = fp.view(U64), np.zeros(len(fp), np.int64), np.arange(len(fp))
    free = ~masks[tree] & (1 << 64) - 1
    for a, b in find_pairs(points, home, masks[tree], search, radius, rules, free, leaf):
        np.add.at(near, a, size[b])
        np.add.at(near, b, size[a])
        la, lb = label[a], label[b]
        differ = la != lb
        if differ.any():
            names, inverse = np.unique(np.concatenate((la[differ], lb[differ])), return_inverse=True)
            half = len(inverse) // 2
            to = names[_roots(len(names), inverse[:half], inverse[half:])]
            renamed = np.arange(len(fp))
            renamed[names] = to
            label = renamed[label]
    at = np.flatnonzero(near)
    return fp[at], near[at], fp[label[at]]


def classes_of(prints: DataFrame) -> DataFrame:
    """fp, no_id (a doc_id is null), least (smallest other doc_id), size of every distinct fingerprint."""
    return prints.groupBy("fp").agg(F.bool_or(F.col("doc_id").isNull()).alias("no_id"), F.min("doc_id").alias("least"), F.count("*").alias("size"))


def class_links(classes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shard: int = SHARD, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """node (fingerprint), near (rows of other classes linked), root: a row for each shard in which a class has links."""
    masks = block_masks((1 << 64) - 1, blocks)
    search = radius // blocks
    n = classes.count()
    if n == 0:
        return classes.sparkSession.createDataFrame([], "node long, near long, root long")
    sample = min(MOST_SAMPLE, max(sample, SAMPLE_A_SHARD * n // shard))
    some = classes.where(F.pmod(F.xxhash64("fp", F.lit("sample")), F.lit(n)) < sample).select("fp").toPandas()["fp"]
    points = np.sort(some.to_numpy(np.int64)).view(U64)
    most = max(64.0, shard * len(points) / n) if n > shard else math.inf
    trees = [grow(points, mask, search, most) for mask in masks]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, size = (batch.column(i).to_numpy() for i in range(2))
            for t, tree in enumerate(trees):
                for shard_id, at, home in route(tree, fp.view(U64), masks[t], search):
                    columns = [np.full(len(at), t, np.int32), np.full(len(at), shard_id, np.int32), fp[at], size[at], home]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["tree", "shard", "fp", "size", "home"])

    def link(table: pa.Table) -> pa.Table:
        fp, size, home = (table.column(c).to_numpy() for c in ("fp", "size", "home"))
        found = shard_links(fp, size, home, masks, table.column("tree")[0].as_py(), radius, leaf)
        return pa.table(dict(zip(("node", "near", "root"), found)))

    # a shard is few bytes and much work: as many tasks as shards, which a plan by bytes would join
    tasks = min(MOST_TASKS, sum(map(leaf_count, trees)))
    sent = classes.select("fp", "size").mapInArrow(send, "tree int, shard int, fp long, size long, home boolean")
    return sent.repartition(tasks, "tree", "shard").groupBy("tree", "shard").applyInArrow(link, "node long, near long, root long")


def grouped_classes(prints: DataFrame, **options) -> DataFrame:
    """fp, n_near, component (a fingerprint), component_id (its smallest doc_id) of every distinct fingerprint of ``prints``."""
    classes = common.materialize(classes_of(prints), "classes")
    links = common.materialize(class_links(classes, **options), "links")
    near = links.groupBy(F.col("node").alias("fp")).agg(F.sum("near").alias("near"))
    edges = links.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    groups = connected_components(edges).withColumnRenamed("node", "fp")
    ids = classes.join(groups, "fp").groupBy("component").agg(F.bool_or("no_id").alias("none"), F.min("least").alias("first"))
    groups = groups.join(ids, "component")
    return (
        classes.join(near, "fp", "left")
        .join(groups, "fp", "left")
        .select(
            "fp",
            (F.col("size") - 1 + F.coalesce("near", F.lit(0))).alias("n_near"),
            F.coalesce("component", "fp").alias("component"),
            F.when(~F.coalesce("none", "no_id"), F.coalesce("first", "least")).alias("component_id"),
        )
    )


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, fp (long), n_near, component_id of every row."""
    prints = common.materialize(fingerprints(docs), "fingerprints")
    return prints.join(grouped_classes(prints, **options), "fp").select("doc_id", "fp", "n_near", "component_id")


def keep_representatives(docs: DataFrame, **options) -> DataFrame:
    """One row of each group, that of the smallest doc_id and then of the least text, with all columns of ``docs``.

    A row is known by its doc_id and text, so rows of other groups that share its doc_id,
    or have none either, stay.  Copies are joined before they are moved.
    """
    key = F.concat(F.coalesce(docs["doc_id"].cast("long").cast("string"), F.lit("none")), F.lit(" "), F.coalesce(F.md5(docs["text"]), F.lit("none")))
    prints = common.materialize(fingerprints(docs.select("doc_id", "text", key.alias("key")), "key"), "fingerprints")
    first = prints.join(grouped_classes(prints, **options), "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("component", "key").distinct()
    rows = docs.select(key.alias("key"), F.struct(*[docs[c] for c in docs.columns]).alias("row")).groupBy("key").agg(F.first("row").alias("row"))
    kept = rows.join(first, "key").groupBy("component").agg(F.min_by("row", F.struct("row.text")).alias("row"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_near", "component_id")
