"""Quality rules by line sequence labelling.

A linear-chain conditional random field labels every line with a word as content or
boilerplate; Viterbi decoding gives the best sequence of a document, and the share
of its words on content lines decides: ``kept`` needs at least ``KEEP_SHARE``.  A
document that fails the base rules (too few words, or too much of it in repeated
3-word windows) isn't kept whatever its lines.

The field is fitted here, in numpy, by full-batch gradient descent on the likelihood
of the lines of a bounded sample of labelled documents (``TRAIN_DOCS``, and the bounds of
``samples``).  Quality is a label of documents; their lines are labelled weakly first:

* a line that stands behind ``SHARED_CONTEXTS`` or more different lines, at least
  ``SHARED_SHARE`` times the number of its documents, is boilerplate (a line of near
  copies mostly stands behind the same line; the hashes of at most ``MOST_SHARED`` such
  lines are part of the model, as a feature);
* a model of single lines learns which lines are of documents of quality 1; a line of a
  quality-0 document that it holds for one of those (``SURE``) is content, and one of a
  quality-1 document that it holds for one of the others is boilerplate.

So documents of either quality mix both labels, and the transitions are learnt from
sequences that switch.  Long documents are fitted in stretches of ``STRETCH`` lines, all
of them.  Without labels of both kinds every line is content.

Defined results: null and empty texts have no words, fail the base rules and aren't
kept; repeated rows give a row each; a null doc_id stays null; an empty table gives
no rows; a very long text is judged whole; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, samples

TRAIN_DOCS = 2000
STRETCH = 32
KEEP_SHARE = 0.5
SHARED_CONTEXTS, SHARED_SHARE, MOST_SHARED = 5, 0.3, 1024
SURE = 0.7
MIN_WORDS = 50
SLICE_BYTES = 4 << 20

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[0x30:0x3A] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[0x41:0x5B] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?")] = True
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True

FEATURES = ("bias", "log_words", "short", "symbols", "symbol_words", "digits", "upper", "punctuation", "ends_sentence", "distinct", "word_length", "duplicate", "shared")


@dataclass
class Lines:
    """The lines with a word of a batch: their features, words, and the first line of each row."""

    features: np.ndarray
    words: np.ndarray
    first: np.ndarray
    hashes: np.ndarray


def _counts(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[ends] - sums[starts]


def line_features(data: np.ndarray, offsets: np.ndarray, word_starts: np.ndarray, word_ends: np.ndarray, word_hash: np.ndarray, shared: np.ndarray) -> Lines:
    starts, ends, _ = common.word_bounds(data != 10, offsets)
    w0, w1 = np.searchsorted(word_starts, starts), np.searchsorted(word_starts, ends)
    held = w1 > w0
    starts, ends, w0, w1 = starts[held], ends[held], w0[held], w1[held]
    first = np.searchsorted(starts, offsets)
    n = len(starts)
    if n == 0:
        return Lines(np.zeros((0, len(FEATURES))), np.zeros(0, np.int64), first, np.zeros(0, np.uint64))
    words = w1 - w0
    size = np.maximum(1, ends - starts).astype(float)
    symbols = _counts(_SYMBOL[data], starts, ends)
    symbol_word = _counts(_SYMBOL[data], word_starts, word_ends) > 0
    line_of_word = np.repeat(np.arange(n), words)
    with np.errstate(over="ignore"):
        key = common.mix(word_hash ^ (line_of_word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key, kind="stable")
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    distinct = np.bincount(line_of_word[order[new]], minlength=n)
    last = data[word_ends[w1 - 1] - 1]
    row = np.searchsorted(first, np.arange(n), side="right") - 1
    hashes = common.word_hashes(data, starts, ends)
    with np.errstate(over="ignore"):
        line_key = common.mix(hashes ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    _, inverse, times = np.unique(line_key, return_inverse=True, return_counts=True)
    features = np.stack(
        [
            np.ones(n),
            np.log1p(words) / 4,
            words < 4,
            symbols / size * 4,
            _counts(symbol_word, w0, w1) / words,
            _counts(_DIGIT[data], starts, ends) / size * 4,
            _counts(_UPPER[data], starts, ends) / size * 4,
            _counts(_PUNCTUATION[data], starts, ends) / size * 4,
            _STOP[last],
            distinct / words,
            size / words / 10,
            times[inverse] > 1,
            np.isin(hashes, shared),
        ],
        axis=1,
    ).astype(float)
    return Lines(features, words, first, hashes)


@dataclass
class Field:
    """Weights of content against boilerplate, transitions [from, to], start scores, and the hashes of known shared lines."""

    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray
    shared: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    @classmethod
    def all_content(cls) -> Field:
        weights = np.zeros(len(FEATURES))
        weights[0] = 1.0
        return cls(weights, np.zeros((2, 2)), np.zeros(2))

    def viterbi(self, lines: Lines) -> np.ndarray:
        """The best label of every line; 1 is content.  All rows advance together, line by line."""
        emission = lines.features @ self.weights
        count = np.diff(lines.first)
        order = np.argsort(-count, kind="stable")
        begin, count = lines.first[:-1][order], count[order]
        back = np.zeros((len(emission), 2), np.int8)
        best = np.zeros((len(order), 2))
        longest = int(count[0]) if len(count) else 0
        active = np.searchsorted(-count, -np.arange(longest), side="left")
        for t in range(longest):
            k = active[t]
            at = begin[:k] + t
            if t == 0:
                score = np.broadcast_to(self.start, (k, 2)).copy()
            else:
                paths = best[:k, :, None] + self.transitions
                back[at] = paths.argmax(axis=1)
                score = paths.max(axis=1)
            score[:, 1] += emission[at]
            best[:k] = score
        labels = np.zeros(len(emission), np.int8)
        now = best.argmax(axis=1).astype(np.int8)
        for t in range(longest - 1, -1, -1):
            k = active[t]
            at = begin[:k] + t
            labels[at] = now[:k]
            now[:k] = back[at, now[:k]]
        return labels


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def fit(features: list[np.ndarray], labels: list[np.ndarray], steps: int = 80, rate: float = 0.5, penalty: float = 1e-4) -> Field:
    """Maximum likelihood by Adam over all stretches at once; ``labels`` has one for each line of a stretch."""
    n, width = len(features), max(map(len, features))
    x = np.zeros((n, width, len(FEATURES)))
    y = np.full((n, width), -1)
    for i, f in enumerate(features):
        x[i, : len(f)] = f
        y[i, : len(f)] = labels[i]
    there = y >= 0
    total = there.sum()
    size = len(FEATURES)
    theta = np.zeros(size + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    # observed counts
    seen = np.zeros_like(theta)
    seen[:size] = x[y == 1].sum(0)
    pair = (2 * y[:, :-1] + y[:, 1:])[there[:, 1:]]
    seen[size : size + 4] = np.bincount(pair, minlength=4)
    seen[size + 4 :] = np.bincount(y[:, 0], minlength=2)
    for step in range(1, steps + 1):
        emission = np.zeros((n, width, 2))
        emission[:, :, 1] = x @ theta[:size]
        trans, start = theta[size : size + 4].reshape(2, 2), theta[size + 4 :]
        alpha = np.zeros((n, width, 2))
        alpha[:, 0] = start + emission[:, 0]
        for t in range(1, width):
            moved = _log_sum(alpha[:, t - 1, :, None] + trans, 1) + emission[:, t]
            alpha[:, t] = np.where(there[:, t, None], moved, alpha[:, t - 1])
        norm = _log_sum(alpha[:, -1], 1)
        beta = np.zeros((n, width, 2))
        expected = np.zeros_like(theta)
        pairs = np.zeros((2, 2))
        for t in range(width - 2, -1, -1):
            ahead = emission[:, t + 1] + beta[:, t + 1]
            joint = alpha[:, t, :, None] + trans + ahead[:, None, :] - norm[:, None, None]
            pairs += np.exp(joint[there[:, t + 1]]).sum(0)
            moved = _log_sum(trans + ahead[:, None, :], 2)
            beta[:, t] = np.where(there[:, t + 1, None], moved, 0.0)
        gamma = np.exp(alpha + beta - norm[:, None, None]) * there[:, :, None]
        expected[:size] = np.einsum("nt,ntf->f", gamma[:, :, 1], x)
        expected[size : size + 4] = pairs.ravel()
        expected[size + 4 :] = gamma[:, 0].sum(0)
        gradient = (seen - expected) / total - penalty * theta
        m = 0.9 * m + 0.1 * gradient
        v = 0.99 * v + 0.01 * gradient**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(theta[:size], theta[size : size + 4].reshape(2, 2), theta[size + 4 :])


def _batch_lines(data: np.ndarray, offsets: np.ndarray, shared: np.ndarray = np.zeros(0, np.uint64)) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Lines]:
    starts, ends, first = common.word_bounds(~common.IS_WHITE[data], offsets)
    hashes = common.word_hashes(data, starts, ends)
    return starts, ends, first, hashes, line_features(data, offsets, starts, ends, hashes, shared)


def shared_lines(lines: Lines) -> np.ndarray:
    """Hashes, ascending, of the lines that stand behind many different lines."""
    row = np.repeat(np.arange(len(lines.first) - 1), np.diff(lines.first))
    before = np.concatenate((np.zeros(1, np.uint64), lines.hashes[:-1]))
    before[lines.first[:-1][np.diff(lines.first) > 0]] = 0
    names, at = np.unique(lines.hashes, return_inverse=True)
    contexts, documents = (np.bincount(np.unique(np.stack((at, np.unique(x, return_inverse=True)[1])), axis=1)[0], minlength=len(names)) for x in (before, row))
    contexts[contexts < SHARED_SHARE * documents] = 0
    most = np.argsort(-contexts, kind="stable")[:MOST_SHARED]
    return np.sort(names[most[contexts[most] >= SHARED_CONTEXTS]])


def weak_labels(lines: Lines, quality: np.ndarray) -> np.ndarray:
    """A label of every line: content or boilerplate; ``quality`` is that of its document."""
    alone = fit(list(lines.features[:, None, :]), [np.array([q]) for q in quality.tolist()])
    # the documents' share of either quality is no evidence about a line
    rate = quality.mean()
    good = 1 / (1 + np.exp(-(lines.features @ alone.weights + alone.start[1] - alone.start[0] - np.log(rate / (1 - rate)))))
    label = np.where(quality == 1, good >= 1 - SURE, good > SURE).astype(int)
    label[lines.features[:, FEATURES.index("shared")] > 0] = 0
    return label


def fit_labelled(rows: list[tuple[str, int]]) -> Field:
    """A field from (text, quality) rows; all content without rows of both kinds."""
    data, offsets = common.string_buffers(pa.array([t for t, _ in rows], pa.large_string()))
    lines = _batch_lines(data, offsets)[4]
    quality = np.repeat(np.array([q for _, q in rows], int), np.diff(lines.first))
    if len(set(quality.tolist())) < 2:
        return Field.all_content()
    shared = shared_lines(lines)
    lines.features[:, FEATURES.index("shared")] = np.isin(lines.hashes, shared)
    label = weak_labels(lines, quality)
    cuts = [a for i in range(len(rows)) for a in range(lines.first[i], lines.first[i + 1], STRETCH)]
    ends = [min(a + STRETCH, b) for i, b in enumerate(lines.first[1:]) for a in range(lines.first[i], b, STRETCH)]
    found = fit([lines.features[a:b] for a, b in zip(cuts, ends)], [label[a:b] for a, b in zip(cuts, ends)])
    found.shared = shared
    return found


def repeated_words(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each row, the words in 3-word windows that the row holds twice or more."""
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)
    if len(hashes) < 3:
        return np.zeros(len(counts), np.int64)
    at = np.flatnonzero(row[2:] == row[:-2])
    if len(at) == 0:
        return np.zeros(len(counts), np.int64)
    with np.errstate(over="ignore"):
        key = (hashes[at] * np.uint64(0x9E3779B97F4A7C15) + hashes[at + 1]) * np.uint64(0xD6E8FEB86659FD93) + hashes[at + 2]
        key = common.mix(key) ^ common.mix(row[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = np.concatenate(([False], key[order][1:] == key[order][:-1]))
    twice = at[order[same | np.concatenate((same[1:], [False]))[: len(same)]]]
    covered = np.zeros(len(hashes), dtype=bool)
    for j in range(3):
        covered[twice + j] = True
    return np.bincount(row[covered], minlength=len(counts))


def judge(docs: DataFrame, model: Field, keep_share: float = KEEP_SHARE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share, n_lines of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.string_buffers(batch.column(1))
            for a, b in common.slices(offsets, SLICE_BYTES):
                part, cuts = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *_judged(part, cuts, model, keep_share)], NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column(docs).alias("text")).mapInArrow(run, SCHEMA)


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share", "n_lines"]
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, n_lines long"


def _judged(data: np.ndarray, cuts: np.ndarray, model: Field, keep_share: float) -> list[pa.Array]:
    starts, ends, first, hashes, lines = _batch_lines(data, cuts, model.shared)
    n_words = np.diff(first)
    in_word = ~common.IS_WHITE[data] & ((data & 0xC0) != 0x80)
    word_chars = _counts(in_word, cuts[:-1], cuts[1:])
    n_symbols = _counts(_SYMBOL[data], cuts[:-1], cuts[1:])
    repeats = repeated_words(hashes, first)
    raw, at = data.tobytes(), cuts.tolist()
    dup_lines = []
    for x, y in zip(at, at[1:]):
        held = [line for line in raw[x:y].split(b"\n") if line.strip()]
        dup_lines.append(len(held) - len(set(held)))
    labels = model.viterbi(lines)
    row = np.repeat(np.arange(len(n_words)), np.diff(lines.first))
    content = np.bincount(row, weights=lines.words * labels, minlength=len(n_words))
    share = content / np.maximum(1, n_words)
    failed = (n_words < MIN_WORDS) | (100 * repeats > 50 * n_words)
    return [
        pa.array(n_words, pa.int64()),
        pa.array(word_chars, pa.int64()),
        pa.array(n_symbols, pa.int64()),
        pa.array(dup_lines, pa.int64()),
        pa.array(repeats, pa.int64()),
        pa.array(failed),
        pa.array(~failed & (share >= keep_share)),
        pa.array(share, pa.float64()),
        pa.array(np.diff(lines.first), pa.int64()),
    ]


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    rows = samples.labelled_rows(docs, common.read_table(spark, sf_dir, "labels"), "quality", TRAIN_DOCS)
    return judge(docs, samples.fit_on_executor(rows, fit_labelled))
