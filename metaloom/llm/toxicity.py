"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Every word (runs of digits, ASCII letters, lower-cased, and non-ASCII characters; one
of more than ``WORD_BYTES`` bytes is several) has two inputs: an embedding of the
word's hash bucket and the mean embedding of its character 3-, 4- and 6-grams (in UTF-8
bytes); in learning, a word's own embedding is left out at times, so that its
characters must tell.  A gated recurrent unit runs over a window of ``WINDOW`` words in
either direction; attention pools its states, and a logistic unit scores the window.
All windows, each overlapping the next by half, of the whole text are scored; a
text's score is its highest window's.  Learnt here in numpy, by Adam on batches of
windows; the first dimension of the embeddings starts at the item's log-odds.

A label belongs to a document, not to a window.  All windows of a clean document
are clean; of a toxic one the window that scores highest is taken for toxic, under
word log-odds at first and under the network itself later (multiple instances).

It is fitted on a bounded sample of labelled rows, at most about ``TRAIN_DOCS`` of
either label in expectation, texts of at most ``samples.TEXT_BYTES`` and
``samples.MOST_BYTES`` in all, and on at most ``KEPT`` windows of each.  The model's
size is fixed; input projections are computed once for each distinct word of a slice
of the corpus.  Slices have at most about ``SLICE_BYTES``: a longer text is scored a
stretch of windows at a time, all of them.

Defined results: a text without words (null, empty, or only punctuation) scores 0, as
does every text if the labels that were learnt from are not of both kinds, so that
nothing is rejected then; repeated rows give a row each; a null doc_id stays null and
isn't held out; an empty table gives no rows; other columns are ignored in ``score``
and kept in ``drop_toxic``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, samples

#: Labelled rows to learn from, at most about: toxic, clean.
TRAIN_DOCS = (2000, 4000)
#: Windows of a clean and of a toxic row to learn from: half those of the highest odds, half any.
KEPT = (12, 12)
THRESHOLD = 0.3
WINDOW, STRIDE = 64, 32
HIDDEN, WORD_DIM, CHAR_DIM = 8, 8, 8
WORD_BUCKETS, CHAR_BUCKETS = 1 << 16, 1 << 15
WORD_BYTES = 32
SLICE_BYTES = 4 << 20
#: Lengths of the character grams, in bytes with a mark on either side of the word.
GRAMS = (3, 4, 6)
#: Share of the distinct words whose own embedding is left out of a learning step.
DROPPED = 0.4
#: Batches that a network is fitted on, and windows in one.
MOVES, BATCH = 120, 128
#: Adam's step at the start; it falls to a tenth.
RATE = 0.015
#: Batches after which the windows to learn from are scored anew, clean ones at most so many.
RESCORED, RIVALS = 40, 16384
#: Windows that advance together.
TOGETHER = 4096

_F = np.float32


@dataclass
class Words:
    """The words of a batch: of each its distinct word, and each row's first."""

    ids: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    hashes: np.ndarray  # of the distinct words
    gram_buckets: np.ndarray  # of their character grams, word by word
    gram_first: np.ndarray


def _word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and each row's first of the words, long ones cut."""
    starts, ends, first = common.word_bounds(common.IS_ALNUM[data], offsets)
    parts = -(-(ends - starts) // WORD_BYTES)
    if len(parts) and parts.max() > 1:
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts, ends = np.repeat(starts, parts) + nth * WORD_BYTES, np.repeat(ends, parts)
        ends = np.minimum(ends, starts + WORD_BYTES)
        first = np.searchsorted(starts, offsets)
    return starts, ends, first


def read_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """``data`` is lower-cased."""
    starts, ends, first = _word_places(data, offsets)
    hashes, at, ids = np.unique(common.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    grams = [_char_grams(data, starts[at[i : i + 32768]], ends[at[i : i + 32768]]) for i in range(0, len(at), 32768)]
    counts = np.concatenate([np.zeros(1, np.int64), *(c for _, c in grams)])
    return Words(ids.astype(np.int32), first, starts, hashes, np.concatenate([np.zeros(0, np.int32), *(g for g, _ in grams)]), np.cumsum(counts))


def _char_grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of the grams of words, word by word; grams of each word); a mark stands on either side of a word."""
    size = ends - starts + 2
    begin = np.concatenate(([0], np.cumsum(size)))
    word = np.repeat(np.arange(len(starts)), size)
    inner = np.arange(begin[-1]) - begin[:-1][word]
    letter = (inner > 0) & (inner < size[word] - 1)
    flat = np.zeros(begin[-1], np.uint64)
    flat[letter] = data[starts[word[letter]] + inner[letter] - 1]
    buckets, owners = [], []
    for n in GRAMS:
        if len(flat) < n:
            continue
        value = np.full(len(flat) - n + 1, n, np.uint64)
        for j in range(n):
            value = value * np.uint64(257) + flat[j : len(flat) - n + 1 + j]
        inside = word[: len(value)] == word[n - 1 :]
        buckets.append((common.mix(value[inside]) % np.uint64(CHAR_BUCKETS)).astype(np.int32))
        owners.append(word[: len(value)][inside])
    owner = np.concatenate(owners)
    return np.concatenate(buckets)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(starts))


def _grams_of(words: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gram buckets of the chosen distinct words, and how many each has."""
    counts = np.diff(words.gram_first)[chosen]
    at = np.repeat(words.gram_first[chosen] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    return words.gram_buckets[at], counts


def windows_of(first: np.ndarray, window: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, length) of every window: from each ``stride``-th word on, until one reaches the row's end."""
    n = np.diff(first)
    count = np.where(n == 0, 0, np.where(n <= window, 1, 1 + -(-(n - window) // stride)))
    row = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    begin = first[row] + nth * stride
    return row, begin, np.minimum(window, first[row + 1] - begin)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _gates(x: np.ndarray, before: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
    """(state after, update gate, reset gate, candidate, candidate's recurrent part) of a gated recurrent unit."""
    h = u.shape[-2]
    g = before @ u
    zr = _sigmoid(x[..., : 2 * h] + g[..., : 2 * h])
    z, r, gn = zr[..., :h], zr[..., h:], g[..., 2 * h :]
    new = np.tanh(x[..., 2 * h :] + r * gn)
    return new + z * (before - new), z, r, new, gn


def _gates_back(d: np.ndarray, before: np.ndarray, z: np.ndarray, r: np.ndarray, new: np.ndarray, gn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gradient of the input's projection, of the recurrent one)."""
    d_new = d * (1 - z) * (1 - new**2)
    d_z = d * (before - new) * z * (1 - z)
    d_r = d_new * gn * r * (1 - r)
    return np.concatenate((d_z, d_r, d_new), axis=-1), np.concatenate((d_z, d_r, d_new * r), axis=-1)


def _summed(keys: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The sums of the rows of ``values`` by key, of ``n`` keys."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    cuts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    out[ranked[cuts]] = np.add.reduceat(values[order], cuts, axis=0)
    return out


class Network:
    """Parameters by name, in ``p``."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        h, c, d = HIDDEN, CHAR_DIM, WORD_DIM + CHAR_DIM
        self.p = {
            "word": rng.normal(0, 0.05, (WORD_BUCKETS, WORD_DIM)),
            "char": rng.normal(0, 0.05, (CHAR_BUCKETS, CHAR_DIM)),
            "wx": rng.normal(0, d**-0.5, (2, d, 3 * h)),
            "bx": np.zeros((2, 3 * h)),
            "u": rng.normal(0, h**-0.5, (2, h, 3 * h)),
            "wa": rng.normal(0, (2 * h) ** -0.5, (2 * h, h)),
            "ba": np.zeros(h),
            "va": rng.normal(0, h**-0.5, h),
            "wo": rng.normal(0, (2 * h) ** -0.5, 2 * h),
            "bo": np.zeros(1),
        }
        self.p = {k: v.astype(_F) for k, v in self.p.items()}

    def inputs(self, hashes: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The inputs of distinct words, each of which has a gram: two marks and a letter."""
        first = np.concatenate(([0], np.cumsum(counts)))
        chars = np.empty((len(hashes), CHAR_DIM), _F)
        for a in range(0, len(hashes), 4096):
            b = min(len(hashes), a + 4096)
            np.add.reduceat(self.p["char"][grams[first[a] : first[b]]], first[a:b] - first[a], axis=0, out=chars[a:b])
        chars /= counts[:, None].astype(_F)
        word = self.p["word"][(hashes % np.uint64(WORD_BUCKETS)).astype(np.int64)]
        return np.concatenate((word, chars), axis=1)

    def projections(self, inputs: np.ndarray) -> np.ndarray:
        out = np.matmul(inputs, self.p["wx"])
        out += self.p["bx"][:, None]
        return out

    def forward(self, projected: np.ndarray, at: np.ndarray, length: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Scores of windows, longest first; at: (windows, width) distinct words. keep: gets what ``backward`` needs."""
        p, h = self.p, HIDDEN
        n, width = at.shape
        active = np.searchsorted(-length, -np.arange(width), side="left")
        rows = np.arange(n)
        state = np.zeros((2, n, h), _F)
        states = np.zeros((width, n, 2 * h), _F)
        steps = []
        for t in range(int(length[0])):
            k = active[t]
            place = length[:k] - 1 - t
            x = np.stack((projected[0][at[:k, t]], projected[1][at[rows[:k], place]]))
            before = state[:, :k]
            after, *rest = _gates(x, before, p["u"])
            if keep is not None:
                steps.append((k, before.copy(), *rest))
            state[:, :k] = after
            states[t, :k, :h] = after[0]
            states[place, rows[:k], h:] = after[1]
        hidden = np.tanh(states @ p["wa"] + p["ba"])
        energy = hidden @ p["va"]
        energy[np.arange(width)[:, None] >= length] = -1e9
        weight = np.exp(energy - energy.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        if keep is not None:
            keep += [steps, states, hidden, weight, pooled]
        return pooled @ p["wo"] + p["bo"][0]

    def backward(self, words_x: np.ndarray, at: np.ndarray, length: np.ndarray, keep: list, d_out: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """(gradients of the parameters behind the words' inputs, gradient of those inputs)."""
        p, h = self.p, HIDDEN
        steps, states, hidden, weight, pooled = keep
        n = len(at)
        rows = np.arange(n)
        g = {"u": np.zeros_like(p["u"]), "wo": pooled.T @ d_out, "bo": d_out.sum(keepdims=True)}
        d_pooled = d_out[:, None] * p["wo"]
        d_weight = np.einsum("nh,tnh->tn", d_pooled, states)
        d_states = weight[:, :, None] * d_pooled
        d_energy = weight * (d_weight - (weight * d_weight).sum(0))
        g["va"] = np.einsum("tn,tnh->h", d_energy, hidden)
        d_hidden = d_energy[:, :, None] * p["va"] * (1 - hidden**2)
        g["wa"] = states.reshape(-1, 2 * h).T @ d_hidden.reshape(-1, h)
        g["ba"] = d_hidden.sum((0, 1))
        d_states += d_hidden @ p["wa"].T
        carry = np.zeros((2, n, h), _F)
        keys: tuple[list, list] = ([], [])
        values: tuple[list, list] = ([], [])
        for t in range(len(steps) - 1, -1, -1):
            k, before, *rest = steps[t]
            place = length[:k] - 1 - t
            d = carry[:, :k]
            d[0] += d_states[t, :k, :h]
            d[1] += d_states[place, rows[:k], h:]
            d_x, d_g = _gates_back(d, before, *rest)
            g["u"] += before.transpose(0, 2, 1) @ d_g
            carry[:, :k] = d * rest[0] + d_g @ p["u"].transpose(0, 2, 1)
            for side, word in enumerate((at[:k, t], at[rows[:k], place])):
                keys[side].append(word)
                values[side].append(d_x[side])
        d_projected = np.stack([_summed(np.concatenate(keys[s]), np.concatenate(values[s]), len(words_x)) for s in (0, 1)])
        g["wx"] = words_x.T @ d_projected
        g["bx"] = d_projected.sum(1)
        return g, sum(d_projected[k] @ p["wx"][k].T for k in (0, 1))

    def score_windows(self, words: Words, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Scores (before the logistic function) of all windows, in blocks of like length."""
        out = np.empty(len(begin), _F)
        projected = self.projections(self.inputs(words.hashes, words.gram_buckets, np.diff(words.gram_first)))
        order = np.argsort(-length, kind="stable")
        last = len(words.ids) - 1
        for a in range(0, len(order), TOGETHER):
            some = order[a : a + TOGETHER]
            width = int(length[some[0]])
            at = words.ids[np.minimum(begin[some, None] + np.arange(width), last)]
            out[some] = self.forward(projected, at, length[some])
        return out


@dataclass
class Model:
    """A network, or None where there was nothing to learn."""

    network: Network | None

    def score(self, data: np.ndarray, offsets: np.ndarray, slice_bytes: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray]:
        """(score, windows) of every row."""
        rows = len(offsets) - 1
        score, counts = np.zeros(rows), np.zeros(rows, np.int64)
        if self.network is None:
            return score, counts
        for a, b in common.slices(offsets, slice_bytes):
            part = data[offsets[a] : offsets[b]]
            if b == a + 1 and len(part) > slice_bytes:
                score[a], counts[a] = self._score_long(part, slice_bytes)
                continue
            words = read_words(common.lower_ascii(part), offsets[a : b + 1] - offsets[a])
            row, begin, length = windows_of(words.first)
            counts[a:b] = np.bincount(row, minlength=b - a)
            if len(row):
                found = self.network.score_windows(words, begin, length)
                held = np.flatnonzero(counts[a:b])
                score[a + held] = _sigmoid(np.maximum.reduceat(found, np.searchsorted(row, held)).astype(float))
        return score, counts

    def _score_long(self, data: np.ndarray, slice_bytes: int) -> tuple[float, int]:
        """(score, windows) of one text, a stretch of whole windows at a time."""
        at, size, best, count = 0, slice_bytes, -np.inf, 0
        while at < len(data):
            to = min(len(data), at + size)
            last = to == len(data)
            words = read_words(common.lower_ascii(data[at:to]), np.array([0, to - at]))
            n = len(words.ids) - (not last)  # the last word may go on behind the stretch
            if last and count and n <= WINDOW - STRIDE:
                break  # the window before has reached the end
            if not last and n < WINDOW:
                if n < 0:
                    at = to
                else:
                    size *= 2
                continue
            if n <= 0:
                break
            _, begin, length = windows_of(np.array([0, n]))
            if not last:
                whole = length == WINDOW
                begin, length = begin[whole], length[whole]
            best = max(best, float(self.network.score_windows(words, begin, length).max()))
            count += len(begin)
            if last:
                break
            at, size = at + int(words.starts[len(begin) * STRIDE]), slice_bytes
        return (float(_sigmoid(best)), count) if count else (0.0, 0)


def _log_odds(words: Words, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How much likelier the distinct words and the buckets of grams are in a toxic text than in a clean one; 0 for those in fewer than 3 texts."""
    by_word, by_gram = np.zeros((2, len(words.hashes))), np.zeros((2, CHAR_BUCKETS))
    for r, label in enumerate(labels.tolist()):
        own = np.unique(words.ids[words.first[r] : words.first[r + 1]])
        by_word[label, own] += 1
        by_gram[label, np.unique(_grams_of(words, own)[0])] += 1
    toxic = int((labels == 1).sum())
    clean = len(labels) - toxic

    def odds(held: np.ndarray) -> np.ndarray:
        return np.where(held.sum(0) >= 3, np.log((held[1] + 0.5) / (toxic + 1)) - np.log((held[0] + 0.5) / (clean + 1)), 0.0)

    return odds(by_word), odds(by_gram)


def _best_of(row: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """Indices of the ``most`` best windows of every row."""
    order = np.lexsort((-scores, row))
    ranked = row[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - lead < most]


def fit(rows: list[tuple[str, int]], total: int = MOVES, batch: int = BATCH, seed: int = 0) -> Model:
    """A model from (text, toxic) rows."""
    labels = np.array([y for _, y in rows], np.int64)
    if len(set(labels.tolist())) < 2:
        return Model(None)
    data, offsets = common.string_buffers(pa.array([t for t, _ in rows], pa.large_string()))
    words = read_words(common.lower_ascii(data), offsets)
    row, begin, length = windows_of(words.first)
    label = labels[row]
    if len(set(label.tolist())) < 2:
        return Model(None)
    rng = np.random.default_rng(seed)
    odds, char_odds = _log_odds(words, labels)
    sums = np.concatenate(([0.0], np.cumsum(np.maximum(odds[words.ids], 0))))
    scores = sums[begin + length] - sums[begin]
    kept = []
    for value in (0, 1):
        own = np.flatnonzero(label == value)
        for order in (scores[own], rng.random(len(own))):
            kept.append(own[_best_of(row[own], order, KEPT[value] // 2)])
    kept = np.unique(np.concatenate(kept))
    row, begin, length, label, scores = (x[kept] for x in (row, begin, length, label, scores))
    net = Network(seed)
    net.p["word"][(words.hashes % np.uint64(WORD_BUCKETS)).astype(np.int64), 0] = np.clip(odds, -3, 3)
    net.p["char"][:, 0] = np.clip(char_odds, -3, 3)
    positives, negatives = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    # a small sample is learnt from in small batches, as many of them
    batch = int(np.clip(len(np.unique(row[positives])), 32, batch))
    moves, due = 0, RESCORED
    while moves < total:
        if moves >= due:
            due += RESCORED
            again = np.concatenate((positives, rng.permutation(negatives)[:RIVALS]))
            scores[negatives] = -np.inf
            scores[again] = net.score_windows(words, begin[again], length[again])
        # each toxic text's best window, twice as many of the hardest clean ones, and as many of any
        best = positives[_best_of(row[positives], scores[positives], 1)]
        hardest = negatives[np.argsort(-scores[negatives], kind="stable")[: 2 * len(best)]]
        chosen = np.concatenate((best, hardest, rng.choice(negatives, len(best))))
        rng.shuffle(chosen)
        for a in range(0, len(chosen), batch):
            if moves == total:
                break
            some = chosen[a : a + batch]
            some = some[np.argsort(-length[some], kind="stable")]
            moves += 1
            _step(net, state, words, begin[some], length[some], label[some], rng, moves, RATE * max(0.1, 1 - moves / total))
    return Model(net)


def gradients(net: Network, words: Words, begin: np.ndarray, length: np.ndarray, label: np.ndarray, dropped: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray], dict[str, np.ndarray]]:
    """(mean loss, gradients by name, rows of the embeddings that they are of) of windows, longest first."""
    flat = words.ids[np.minimum(begin[:, None] + np.arange(int(length[0])), len(words.ids) - 1)]
    used, at = np.unique(flat, return_inverse=True)
    at = at.reshape(flat.shape)
    grams, counts = _grams_of(words, used)
    keep: list = []
    x = net.inputs(words.hashes[used], grams, counts)
    left_out = np.zeros(len(used), dtype=bool) if dropped is None else dropped[used]
    x[left_out, :WORD_DIM] = 0
    out = net.forward(net.projections(x), at, length, keep)
    g, d_x = net.backward(x, at, length, keep, ((_sigmoid(out) - label) / len(label)).astype(_F))
    d_x[left_out, :WORD_DIM] = 0
    rows = {}
    for k, bucket, d in (
        ("word", (words.hashes[used] % np.uint64(WORD_BUCKETS)).astype(np.int64), d_x[:, :WORD_DIM]),
        ("char", grams, np.repeat(d_x[:, WORD_DIM:] / counts[:, None].astype(_F), counts, axis=0)),
    ):
        rows[k], inverse = np.unique(bucket, return_inverse=True)
        g[k] = _summed(inverse.astype(np.uint16 if len(rows[k]) < 1 << 16 else np.int64), d, len(rows[k]))
    loss = np.logaddexp(0, np.where(label == 1, -out, out).astype(float)).mean()
    return float(loss), g, rows


def _step(net: Network, state: dict, words: Words, begin: np.ndarray, length: np.ndarray, label: np.ndarray, rng: np.random.Generator, moves: int, rate: float) -> None:
    _, found, rows = gradients(net, words, begin, length, label, rng.random(len(words.hashes)) < DROPPED)
    b1, b2 = 1 - 0.9**moves, 1 - 0.99**moves
    for k, g in found.items():
        at = rows.get(k, slice(None))
        m, v = state[k]
        m[at] += 0.1 * (g - m[at])
        v[at] += 0.01 * (g * g - v[at])
        net.p[k][at] -= rate * (m[at] / b1) / (np.sqrt(v[at] / b2) + 1e-6)


def held_out(doc_id):
    """Whether a row is left out of learning: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, train_docs: tuple[int, int] = TRAIN_DOCS) -> Model:
    """A model from the labelled rows that aren't held out."""
    rows = samples.labelled_rows(docs, labels, "toxic", {1: train_docs[0], 0: train_docs[1]}, ~held_out(F.col("doc_id")))
    return samples.fit_on_executor(rows, fit)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, n_windows of every row; no shuffle. The model is of fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, windows = shared.value.score(*common.string_buffers(batch.column(1)))
            common.release()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64()), pa.array(windows, pa.int64())], ["doc_id", "score", "n_windows"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column(docs).alias("text"))
    scored = slim.mapInArrow(run, "doc_id long, score double, n_windows long")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_windows")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, _ = shared.value.score(*common.string_buffers(batch.column(batch.schema.get_field_index("text"))))
            common.release()
            yield batch.filter(pa.array(found < threshold))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    return score(docs, learn(docs, common.read_table(spark, sf_dir, "labels")))
