"""Best-fit packing of token sequences under vector capacities.

A bin (sequence) has three capacities: tokens, documents and attention cost (the
sum of the squared lengths of its pieces).  An item's demand follows from its
length alone, (length, 1, length squared), so items of one length are alike and
the packing is planned on the *histogram of lengths*, at most ``capacity`` rows
whatever the size of the corpus: lengths descend, and every item goes to the open
bin that fits under every capacity and scores best, by the weighted dot product
of demand and residual or by the weighted norm of the residual left.  Bins in one
state are one class with a multiplicity, so the plan's size doesn't follow the
number of items either.

Items then take their places by rank among those of their length.  Ranks are
counted per input slice first and offset by the slices before (no global sort; a
length that a third of all pieces have is ranked in all slices at once).

Documents longer than the capacity are cut into full pieces, of which the first
may be shorter; full pieces are sequences by themselves.

Defined results: a null text is empty and has the end id alone; repeated rows are
packed as rows of their own; a null doc_id stays null; an empty table gives no
rows; a very long text is encoded in parts and cut in pieces; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import bpe, common

CAPACITY = 1024
END_ID = 2
#: Documents whose pieces are held together in a Python worker.
ROWS_TOGETHER = 1000


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence, and how the bins that fit are scored.

    ``rule`` is "norm" (least weighted norm of the residual left) or "dot" (greatest
    weighted dot product of demand and residual), in shares of the capacities.  The
    default document and cost capacities are the least that allow every sequence of at
    most ``tokens`` tokens, so they refuse none; through the norm they choose all the
    same: of the bins that fit, one whose tokens, documents and attention are all
    nearly used up goes before one that is full of tokens alone.
    """

    tokens: int = CAPACITY
    documents: int = CAPACITY
    cost: int = CAPACITY * CAPACITY
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    rule: str = "norm"

    def fits(self, length: int, residual: tuple[int, int, int]) -> int:
        """Items of ``length`` that a bin with this residual still takes."""
        return min(residual[0] // length, residual[1], residual[2] // (length * length))

    def score(self, length: int, residual: tuple[int, int, int]) -> float:
        """Lower is better."""
        whole = (self.tokens, self.documents, self.cost)
        demand = (length, 1, length * length)
        if self.rule == "dot":
            return -sum(w * d * r / c / c for w, d, r, c in zip(self.weights, demand, residual, whole))
        return sum(w * ((r - d) / c) ** 2 for w, d, r, c in zip(self.weights, demand, residual, whole))


@dataclass
class Plan:
    """Places of the items of each length, as runs over their ranks.

    A run (rank, per_bin, sequence, offset): items from ``rank`` on fill sequences
    from ``sequence`` on, ``per_bin`` each, the first at ``offset`` and the next
    behind it.
    """

    runs: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)
    sequences: int = 0

    def places(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for length in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == length)
            runs = np.array(self.runs[length], np.int64)
            run = runs[np.searchsorted(runs[:, 0], ranks[at], side="right") - 1]
            behind = ranks[at] - run[:, 0]
            sequence[at] = run[:, 2] + behind // run[:, 1]
            offset[at] = run[:, 3] + behind % run[:, 1] * length
        return sequence, offset


class _Bins:
    """Open bins by state: residual to stretches [first, count) of sequence numbers."""

    def __init__(self):
        self.by_state: dict[tuple[int, int, int], list[list[int]]] = {}
        self.tokens: list[int] = []  # residual tokens that occur, ascending
        self.with_tokens: dict[int, set[tuple[int, int, int]]] = {}

    def add(self, state: tuple[int, int, int], first: int, count: int) -> None:
        if min(state) <= 0:
            return
        if state not in self.by_state:
            self.by_state[state] = []
            if state[0] not in self.with_tokens:
                self.with_tokens[state[0]] = set()
                self.tokens.insert(bisect_right(self.tokens, state[0]), state[0])
            self.with_tokens[state[0]].add(state)
        self.by_state[state].append([first, count])

    def take(self, state: tuple[int, int, int], most: int) -> tuple[int, int]:
        stretch = self.by_state[state][-1]
        first, count = stretch[0], min(most, stretch[1])
        stretch[0] += count
        stretch[1] -= count
        if not stretch[1]:
            self.by_state[state].pop()
            if not self.by_state[state]:
                del self.by_state[state]
                self.with_tokens[state[0]].discard(state)
                if not self.with_tokens[state[0]]:
                    del self.with_tokens[state[0]]
                    self.tokens.remove(state[0])
        return first, count

    def best(self, length: int, limits: Limits) -> tuple[int, int, int] | None:
        found, score = None, 0.0
        for tokens in self.tokens[bisect_right(self.tokens, length - 1) :]:
            for state in self.with_tokens[tokens]:
                if limits.fits(length, state) and (found is None or (s := limits.score(length, state), state) < (score, found)):
                    found, score = state, limits.score(length, state)
            if found is not None and limits.rule == "norm" and limits.weights[0] * ((tokens + 1 - length) / limits.tokens) ** 2 > score:
                break  # a looser bin's token residual alone outweighs the best
        return found


def plan(histogram: dict[int, int], limits: Limits = Limits()) -> Plan:
    """Best-fit decreasing over a histogram of lengths."""
    out, bins = Plan(), _Bins()
    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        left, rank, runs = histogram[length], 0, []
        while left:
            state = bins.best(length, limits)
            if state is None:
                state = (limits.tokens, limits.documents, limits.cost)
                per = limits.fits(length, state)
                if not per:
                    raise ValueError(f"an item of {length} tokens fits no sequence")
                if left >= per:
                    first, count = out.sequences, left // per
                else:
                    per, first, count = left, out.sequences, 1
                out.sequences += count
            else:
                per = limits.fits(length, state)
                if left >= per:
                    first, count = bins.take(state, left // per)
                else:
                    per = left
                    first, count = bins.take(state, 1)
            runs.append((rank, per, first, limits.tokens - state[0]))
            bins.add((state[0] - per * length, state[1] - per, state[2] - per * length * length), first, count)
            rank += per * count
            left -= per * count
        out.runs[length] = runs
    return out


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def encode_ids(texts: list[str], tokenizer_file: str, rank_file: str | None) -> Iterator[np.ndarray]:
    """The ids that the tokenizer file gives each text, without special tokens added.

    The rank file holds the same vocabulary and pattern, and its encoder is several times
    faster.  It gives the same ids (tests compare them) where a text holds none of the
    tokenizer's added tokens, which are ids of their own, and no character from U+0250 on,
    whose class depends on a library's version of Unicode; other texts, whole, go to the
    tokenizer itself.
    """
    tokenizer = _tokenizer(tokenizer_file)
    fast = bpe.encoding(rank_file, public_tokenizers.PATTERN) if rank_file else None
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    for text in texts:
        if fast is not None and (text.isascii() or max(text) < "ɐ") and not any(t in text for t in added):
            ids = bpe.encode_text(fast, text)
        else:
            ids = [i for part in bpe.safe_parts(text) for i in tokenizer.encode(part, add_special_tokens=False).ids]
        yield np.array(ids, "<u4")


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: one, or full ones behind a first that may be shorter."""
    n = len(ids)
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((a, capacity) for a in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer_file: str | None = None, rank_file: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece, and its input slice and rank there among its length."""
    tokenizer_file = tokenizer_file or public_tokenizers.path("byte_bpe_50k.json")
    rank_file = rank_file or public_tokenizers.path("byte_bpe_50k.tiktoken")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "slice", "rank", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        # a retried task has another name; only what one attempt wrote is ever read
        slice_id = uuid.uuid4().hex
        ranks = np.zeros(capacity + 1, np.int64)
        for whole in batches:
            common.release()
            for a in range(0, len(whole), ROWS_TOGETHER):
                batch = whole.slice(a, ROWS_TOGETHER)
                rows: list[tuple] = []
                out_ids: list[np.ndarray] = []
                texts = [t or "" for t in batch.column(1).to_pylist()]
                for doc_id, ids in zip(batch.column(0).to_pylist(), encode_ids(texts, tokenizer_file, rank_file)):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for nth, (start, length) in enumerate(cut(ids, capacity)):
                        part = ids[start : start + length]
                        rows.append((doc_id, nth, start, length, zlib.crc32(part.tobytes()), slice_id, int(ranks[length])))
                        ranks[length] += 1
                        if with_ids:
                            out_ids.append(part)
                columns = list(zip(*rows)) or [()] * 7
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                if with_ids:
                    flat = np.concatenate(out_ids).astype(np.int32) if out_ids else np.zeros(0, np.int32)
                    arrays.append(pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(x) for x in out_ids]))).astype(np.int32), flat))
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, slice string, rank long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def pack(docs: DataFrame, limits: Limits = Limits(), **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece.

    ``options`` go to ``pieces``.
    """
    cut_pieces = common.materialize(pieces(docs, capacity=limits.tokens, **options), "pieces")
    counts = cut_pieces.groupBy("length", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = common.materialize(counts.select("length", "slice", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")), "offsets")
    # at most ``capacity`` rows, whatever the corpus
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    planned = plan(histogram, limits)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            sequence, offset = planned.places(lengths, batch.column("rank").to_numpy() + batch.column("ahead").to_numpy())
            keep = [i for i, c in enumerate(batch.schema.names) if c not in ("slice", "rank", "ahead")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                [*(batch.schema.names[i] for i in keep), "sequence_id", "offset"],
            )

    # a row for each slice and length: it grows with the corpus, so it is never broadcast
    ranked = cut_pieces.join(counts.drop("n").hint("merge"), ["length", "slice"])
    columns = [c for c in cut_pieces.columns if c not in ("slice", "rank")]
    ranked = ranked.select(*columns, "slice", "rank", "ahead")
    schema = ", ".join(f"{c} {t}" for c, t in cut_pieces.select(*columns).dtypes) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(common.read_table(spark, sf_dir, "documents"))
