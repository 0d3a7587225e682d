"""Operators over the whole corpus against brute force: toxicity, near and substring dedup, packing, SpotSigs, chat, pipeline."""

import hashlib
import os
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from metaloom.llm import chat, common, packing, simhash, spotsigs, substring_dedup, toxicity
from metaloom.llm.components import connected_components

ROOT = os.path.dirname(corpus_pipeline.__file__)
SF = "/root/testdata/sf0.001"
FIELDS = "doc_id long, text string, lang string, source string, n_chars long, mark_id long, size int, row string"
EDGE = [(1, None), (2, ""), (3, " \t"), (4, "x" * 100_000), (5, "word " * 20_000), (6, "same text here"), (6, "same text here"), (7, "same text here"), (None, "no id"), (8, None)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), 1, 2, "r") for i, t in rows], FIELDS)


def docs_of(sf):
    return pd.read_parquet(f"{sf}/documents.parquet").sort_values("doc_id").reset_index(drop=True)


# -- toxicity


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.normal(size=(5, toxicity.WORD_DIM + toxicity.CHAR_DIM))
    at, length = rng.integers(0, 5, (3, 4)), np.array([4, 3, 1])
    weight = rng.normal(size=3)

    def loss():
        return float(net.forward(net.projections(x).astype(np.float64), at, length) @ weight)

    old = toxicity._F
    toxicity._F = np.float64
    try:
        keep = []
        net.forward(net.projections(x), at, length, keep)
        grads, d_x = net.backward(x, at, length, keep, weight)
        for name, g in [*grads.items(), ("x", d_x)]:
            target = x if name == "x" else net.p[name]
            for place in list(np.ndindex(target.shape))[:: max(1, target.size // 12)]:
                was = target[place]
                target[place] = was + 1e-5
                up = loss()
                target[place] = was - 1e-5
                down = loss()
                target[place] = was
                assert abs((up - down) / 2e-5 - g[place]) < 1e-4, (name, place)
    finally:
        toxicity._F = old


@given(st.lists(st.integers(0, 400), max_size=6))
@settings(max_examples=100, deadline=None)
def test_windows_cover_whole_texts(sizes):
    first = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    row, begin, length = toxicity.windows_of(first)
    for r, n in enumerate(sizes):
        spans = [(b - first[r], b - first[r] + k) for x, b, k in zip(row, begin, length) if x == r]
        assert {i for a, b in spans for i in range(a, b)} == set(range(n))
        assert all(a2 - a1 == toxicity.STRIDE for (a1, _), (a2, _) in zip(spans, spans[1:])) and all(b - a <= toxicity.WINDOW for a, b in spans)


def test_op2_learns_and_holds_out(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.op2_toxicity(spark, sf).toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    both = got.merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    test = both[both.held_out]
    assert test[test.toxic == 1].predicted.mean() > 0.85 and test[test.toxic == 0].predicted.mean() < 0.05


def tiny_model():
    return toxicity.fit([(f"good words here {i}", 0) for i in range(20)] + [(f"you vile scum {i}", 1) for i in range(20)], total=60)


def test_toxicity_of_one_class_rejects_nothing(spark):
    labels = spark.createDataFrame([(i, 0, 1) for i in range(9)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(table(spark, [(i, f"vile scum {i}") for i in range(9)]), labels)
    assert model.network is None and toxicity.drop_toxic(table(spark, EDGE), model).count() == len(EDGE)


@given(st.integers(0, 2**32 - 1), st.integers(0, 900))
@settings(max_examples=60, deadline=None)
def test_long_texts_are_scored_as_whole_ones(seed, n):
    rng = np.random.default_rng(seed)
    parts = ["vile", "good", "scum", "é", " ", "  .  ", "\n", "x" * 70, " " * 300, "here "]
    text = "".join(parts[i] for i in rng.integers(0, len(parts), n)).encode()
    model, data, cuts = tiny_network(), np.frombuffer(text, np.uint8), np.array([0, len(text)])
    (whole,), (count,) = model.score(data, cuts)
    for size in (16, 700, 2048):
        (score,), (windows,) = model.score(data, cuts, size)
        assert windows == count and abs(score - whole) < 1e-6


def tiny_network():
    if not _TINY:
        _TINY.append(tiny_model())
    return _TINY[0]


_TINY: list = []


def test_a_text_of_40_mb_is_scored_in_1_gb():
    code = """
import resource, numpy as np
from metaloom.llm import toxicity
text = np.frombuffer(b" ".join(b"w%d" % (i * 7919 % 3000017) for i in range(5_000_000)), np.uint8)
assert len(text) > 40_000_000
score, windows = toxicity.Model(toxicity.Network()).score(text, np.array([0, len(text)]))
assert windows[0] == 156249, windows
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=ROOT, env=os.environ | {"OMP_NUM_THREADS": "1"})
    assert int(done.stdout) < 1000


def test_toxicity_edges(spark):
    model = tiny_model()
    got = toxicity.score(table(spark, EDGE), model).toPandas()
    assert len(got) == len(EDGE) and (got[got.doc_id.isin([1, 2, 3, 8])].score == 0).all()
    assert not got[got.doc_id.isna()].held_out.any()
    assert toxicity.score(table(spark, []), model).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    none = toxicity.learn(table(spark, EDGE), labels)
    assert none.network is None and toxicity.drop_toxic(table(spark, EDGE), none).count() == len(EDGE)
    one = toxicity.score(table(spark, [(1, "vile scum"), (2, "good words")]), model).toPandas()
    assert one.predicted.tolist() == [1, 0]


# -- near duplicates


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(x) for x in zip(words, words[1:])] or words
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(ids, prints):
    p = np.array(prints, np.uint64)
    near = np.bitwise_count(p[:, None] ^ p[None, :]) <= 6
    label = np.array(ids)
    while True:
        new = np.array([label[r].min() for r in near])
        if (new == label).all():
            return near.sum(1) - 1, label
        label = new


def test_op3(spark):
    docs = docs_of(SF)
    got = simhash.op3_simhash(spark, SF).toPandas().sort_values("doc_id")
    prints = [brute_print(t) for t in docs.text]
    assert got.fingerprint.tolist() == [f"{p:016x}" for p in prints]
    near, group = brute_groups(docs.doc_id.tolist(), prints)
    assert got.n_near.tolist() == near.tolist() and got.component_id.tolist() == group.tolist()


@pytest.mark.parametrize("shard,leaf,sample", [(64, 8, 4096), (10_000, 16, 10), (300, 4000, 500)])
def test_forest_finds_every_pair_once(shard, leaf, sample):
    rng = np.random.default_rng(shard)
    base = rng.integers(0, 2**63, 500, dtype=np.int64).view(np.uint64)
    moved = base.copy()
    for _ in range(5):
        moved ^= np.uint64(1) << rng.integers(0, 64, len(moved)).astype(np.uint64)
    hot = np.uint64(77) | (rng.integers(0, 2**20, 900, dtype=np.int64).view(np.uint64) << np.uint64(16))
    points = np.unique(np.concatenate((base, moved, hot)))
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(np.bitwise_count(points[:, None] ^ points[None, :]) <= 6, 1)))}
    masks, got = simhash.block_masks((1 << 64) - 1, 4), []
    for t, mask in enumerate(masks):
        rules = [*((m, 1, False) for m in masks[:t]), (mask, 1, True)]
        tree = simhash.grow(points[:sample], mask, 1, shard)
        for _, at, home in simhash.route(tree, points, mask, 1):
            for a, b in simhash.find_pairs(points[at], home, mask, 1, 6, rules, ~mask & (1 << 64) - 1, leaf):
                got += [tuple(sorted(x)) for x in zip(at[a].tolist(), at[b].tolist())]
    assert len(got) == len(set(got)) and set(got) == want


def test_small_shards_give_the_same_groups(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    a = simhash.near_duplicates(docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    b = simhash.near_duplicates(docs, shard=40, sample=300, leaf=8).toPandas().sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(200, 200)] + [(500, i) for i in range(300, 340)]
    label = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[n] == label[n] for n in got) and set(got) == set(label) - {200}


def test_near_edges(spark):
    got = simhash.near_duplicates(table(spark, EDGE)).toPandas()
    assert len(got) == len(EDGE) and (got[got.doc_id.isin([1, 2, 3, 8])].component_id == 1).all() and (got[got.doc_id.isin([1, 2, 3, 8])].n_near == 3).all()
    assert got[got.doc_id == 6].n_near.tolist() == [2, 2] and got[got.doc_id == 7].component_id.item() == 6
    assert simhash.near_duplicates(table(spark, [])).count() == 0
    kept = simhash.keep_representatives(table(spark, EDGE))
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == table(spark, []).columns and sorted(i for i in ids if i is not None) == [1, 4, 5, 6] and ids.count(None) == 1


def test_null_and_repeated_ids_are_told_apart_by_text(spark):
    words = "amber birch cedar dune ember fjord grove heath inlet".split()
    texts = [" ".join(words[i:] + [f"{w}{k}" for k in range(9)]) for i, w in enumerate(words)]
    rows = [(None, t) for t in texts[:4]] + [(5, t) for t in texts[4:7]] + [(9, texts[0]), (9, texts[1]), (9, texts[7]), (None, texts[4]), (4, texts[6]), (None, texts[2])]
    got = simhash.near_duplicates(table(spark, rows)).toPandas()
    prints = np.array([brute_print(t) for _, t in rows], np.uint64)
    near, group = brute_groups([-1 if i is None else i for i, _ in rows], prints.tolist())
    want = sorted(zip([-1 if i is None else i for i, _ in rows], prints.view(np.int64).tolist(), near.tolist(), group.tolist()))
    assert sorted(got.fillna(-1).astype({"doc_id": "int64", "component_id": "int64"}).itertuples(index=False, name=None)) == want
    assert len(set(prints.tolist())) == 8 and near.tolist() == [1, 1, 1, 0, 1, 0, 1, 1, 1, 0, 1, 1, 1]
    kept = [(r["doc_id"], r["text"]) for r in simhash.keep_representatives(table(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([(None, t) for t in texts[:5]] + [(5, texts[5]), (4, texts[6]), (9, texts[7])], key=str)


# -- substring dedup


def brute_removed(rows, k):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first, gone = {}, {i: set() for i in words}
    for i in sorted(words):
        for s in range(len(words[i]) - k + 1):
            window = tuple(words[i][s : s + k])
            if window in first:
                gone[i] |= set(range(s, s + k))
            first.setdefault(window, (i, s))
    return {i: (len(w), len(gone[i]), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone[i]).encode()).hexdigest()) for i, w in words.items()}


def digests(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()}


def test_op9(spark):
    docs = docs_of(SF)
    assert digests(substring_dedup.op9_substring_dedup(spark, SF)) == brute_removed(list(zip(docs.doc_id, docs.text)), 20)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14), min_size=1, max_size=8), st.integers(1, 3))
def test_windows_of_few_words(texts, buckets):
    """The map and bucket kernels alone, small windows, two batches."""
    k, m = 4, 2
    rows = [(i, " \n".join(t)) for i, t in enumerate(texts)]
    by_bucket, packer = {}, substring_dedup.Packer(b"a b c a b c")
    for part in (rows[::2], rows[1::2]):
        data, offsets = common.string_buffers(pa.array([t for _, t in part], pa.string()))
        for bucket, payload in substring_dedup._map_runs([np.array([i for i, _ in part], np.int64)], data, offsets, buckets, k, m, packer):
            by_bucket.setdefault(bucket, []).append(payload)
    stretches = {i: [] for i, _ in rows}
    for payloads in by_bucket.values():
        for doc, start, size in zip(*substring_dedup._duplicates(payloads, k, packer)):
            stretches[int(doc)].append({"start": int(start), "windows": int(size)})
    got = {}
    for i, t in rows:
        n, kept = substring_dedup.kept_words(t.encode(), stretches[i], k)
        got[i] = (n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    assert got == brute_removed(rows, k)


def test_hash_collisions_remove_nothing(monkeypatch):
    monkeypatch.setattr(common, "mix", lambda x: x & np.uint64(3))
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdef") for _ in range(30))) for i in range(12)]
    data, offsets = common.string_buffers(pa.array([t for _, t in rows], pa.string()))
    stretches = {i: [] for i, _ in rows}
    payloads, packer = {}, substring_dedup.Packer()
    for bucket, payload in substring_dedup._map_runs([np.arange(12)], data, offsets, 2, 4, 2, packer):
        payloads.setdefault(bucket, []).append(payload)
    for p in payloads.values():
        for doc, start, size in zip(*substring_dedup._duplicates(p, 4, packer)):
            stretches[int(doc)].append({"start": int(start), "windows": int(size)})
    want = brute_removed(rows, 4)
    for i, t in rows:
        n, kept = substring_dedup.kept_words(t.encode(), stretches[i], 4)
        assert (n, n - len(kept)) == want[i][:2]


def brute_rows(rows, k):
    """(words, removed, digest) of every row, where doc_ids may be null and repeat."""
    found = [(-1 if i is None else i, hashlib.md5((t or "").encode()).digest(), re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, tag, words in found:
        for s in range(len(words) - k + 1):
            window = tuple(words[s : s + k])
            least[window] = min(least.get(window, (i, tag, s)), (i, tag, s))
    out = []
    for (i, _), (key, tag, words) in zip(rows, found):
        gone = {j for s in range(len(words) - k + 1) if least[tuple(words[s : s + k])] != (key, tag, s) for j in range(s, s + k)}
        out.append((i, len(words), len(gone), hashlib.sha256(" ".join(w for j, w in enumerate(words) if j not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def repeated_ids():
    rng = random.Random(3)
    passages = [" ".join(f"{c}{i}" for i in range(30)) for c in "pqr"]
    texts = [" ".join(rng.choice(passages) if rng.random() < 0.5 else f"u{rng.randrange(40)}" for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    return [(rng.choice([None, None, 1, 7, 7, 8, 9]), t) for t in texts] + [(1, passages[0]), (7, passages[0]), (7, "only " + passages[1]), (None, None), (None, "")]


@pytest.mark.parametrize("options", [{}, {"bucket_bytes": 500}, {"most_bytes": 200}, {"bucket_bytes": 1 << 20, "most_bytes": 2000}])
def test_repeated_and_null_ids_and_large_buckets(spark, options):
    rows = repeated_ids()
    got = substring_dedup.removal_digests(table(spark, rows), **options).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_rows(rows, 20)
    plain = list(enumerate(t for _, t in rows))
    got = substring_dedup.removal_digests(table(spark, plain), **options).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_rows(plain, 20)


def test_sql_of_repeated_and_null_ids():
    import duckdb

    rows = repeated_ids()
    documents = pd.DataFrame({"doc_id": pd.array([i for i, _ in rows], "Int64"), "text": [t for _, t in rows]})  # noqa: F841
    assert sorted(duckdb.sql(substring_dedup.OP9_SQL).fetchall(), key=str) == brute_rows(rows, 20)


def test_unique_texts_survive_the_pipeline_stages(spark):
    cc, dd = (" ".join(f"{c}{i}" for i in range(40)) for c in "cd")
    docs = table(spark, [(1, cc), (7, cc), (7, dd), (None, dd + " more"), (None, "another text"), (None, cc)])
    left = [(r["doc_id"], r["text"]) for r in substring_dedup.apply_removals(docs).collect()]
    assert sorted(left, key=str) == sorted([(1, ""), (7, ""), (7, ""), (None, dd + " more"), (None, "another text"), (None, cc)], key=str)


def test_substring_edges(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    rows = [*EDGE, (20, passage), (21, "lead " + passage + " tail"), (22, passage.replace(" ", "\n "))]
    got = substring_dedup.removal_digests(table(spark, rows)).toPandas()
    assert len(got) == len(rows) and got[got.doc_id == 20].n_removed.item() == 0
    assert got[got.doc_id == 21].n_removed.item() == 30 == got[got.doc_id == 22].n_removed.item()
    assert got[got.doc_id == 5].n_removed.item() == 19_999
    out = substring_dedup.apply_removals(table(spark, rows))
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert out.columns == table(spark, []).columns and texts[21] == "lead tail" and texts[1] is None and texts[20] == passage
    assert substring_dedup.removal_digests(table(spark, [])).count() == 0


# -- packing


def check_packing(rows, texts, limits, ids_of):
    by_doc = {}
    for r in rows.to_dict("records"):
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, t in texts:
        ids = np.array([*ids_of(t or ""), 2], "<u4")
        parts = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["start"] for r in parts] == [0, *np.cumsum([r["length"] for r in parts])[:-1]] and sum(r["length"] for r in parts) == len(ids)
        assert all(r["length"] == limits.tokens for r in parts[1:]) and len(parts) == -(-len(ids) // limits.tokens)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in parts)
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]]
        assert own.length.sum() <= limits.tokens and len(own) <= limits.documents and (own.length**2).sum() <= limits.cost


def test_op5(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.op5_best_fit_packing(spark, SF).toPandas()
    docs = docs_of(SF)
    check_packing(rows, list(zip(docs.doc_id, docs.text)), packing.Limits(), lambda t: tokenizer.encode(t, add_special_tokens=False).ids)
    assert rows.sequence_id.nunique() <= 1.02 * rows.length.sum() / 1024 + 1


@pytest.mark.parametrize("limits", [packing.Limits(64), packing.Limits(64, 3, 2500), packing.Limits(64, 64, 3000, (1, 1, 1), "dot"), packing.Limits(50, 2, 10**6, rule="dot")])
def test_plans_obey_every_capacity(limits):
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, limits.tokens + 1, 3000)
    lengths = lengths[lengths**2 <= limits.cost]
    values, counts = np.unique(lengths, return_counts=True)
    planned = packing.plan(dict(zip(values.tolist(), counts.tolist())), limits)
    each, ranks = np.repeat(values, counts), np.concatenate([np.arange(c) for c in counts])
    sequence, offset = planned.places(each, ranks)
    frame = pd.DataFrame({"s": sequence, "o": offset, "n": each}).sort_values(["s", "o"])
    for _, own in frame.groupby("s"):
        assert own.o.tolist() == [0, *own.n.cumsum().tolist()[:-1]]
        assert own.n.sum() <= limits.tokens and len(own) <= limits.documents and (own.n**2).sum() <= limits.cost
    assert frame.s.nunique() == planned.sequences


def test_all_three_capacities_choose():
    lengths = np.random.default_rng(4).integers(1, 1025, 20_000)
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    vector, scalar = packing.plan(histogram), packing.plan(histogram, packing.Limits(weights=(1.0, 0.0, 0.0)))
    assert vector.runs != scalar.runs and vector.sequences <= 1.01 * lengths.sum() / 1024 + 1 and abs(vector.sequences - scalar.sequences) <= 0.001 * scalar.sequences


def test_ids_are_the_tokenizer_files_own():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["x <|endoftext|> y", "<|endoftext|>" * 3, "plain", "", "漢字 <|endoftext|>é", "word " * 30_000 + "<|endoftext|>" + " word" * 30_000, "a <|endoftext |> b"]
    got = packing.encode_ids(texts, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert [x.tolist() for x in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@given(st.text(st.characters(max_codepoint=0x24F, exclude_categories=["Cs"]), max_size=60))
@settings(max_examples=300, deadline=None)
def test_fast_ids_equal_the_tokenizers(text):
    tokenizer_file, rank_file = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    fast, slow = (next(packing.encode_ids([text], tokenizer_file, r)).tolist() for r in (rank_file, None))
    assert fast == slow


def test_packing_edges(spark):
    rows = packing.pack(table(spark, EDGE), with_ids=True).toPandas()
    assert rows[rows.doc_id == 1].length.tolist() == [1] and rows.doc_id.isna().any() and packing.pack(table(spark, [])).count() == 0
    assert rows.groupby("sequence_id").length.sum().max() <= 1024 and [len(x) for x in rows.ids] == rows.length.tolist()


# -- SpotSigs


def brute_spots(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    anchors = set(spotsigs.ANCHORS)
    content = [(i, w) for i, w in enumerate(words) if w not in anchors]
    out = set()
    for i, w in enumerate(words):
        chain = [x for j, x in content if j > i][:2] if w in anchors else []
        out |= {(w, *chain)} if len(chain) == 2 else set()
    return out or ({tuple(words)} if words else set())


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


@pytest.mark.parametrize("ranges", [1, 7, 300, None])
def test_op8(spark, ranges):
    docs = docs_of(SF)
    got = spotsigs.edited_fingerprints(spark.read.parquet(f"{SF}/documents.parquet"), ranges=ranges).toPandas().sort_values("doc_id").reset_index(drop=True)
    texts = [t or "" for t in docs.text]
    following = texts[1:] + texts[:1]
    for i, (t, n) in enumerate(zip(texts, following)):
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        a = brute_spots(t)
        r = got.loc[i]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (docs.doc_id[i], len(t), hashlib.sha256(e.encode()).hexdigest())
        assert r.near_edited == pytest.approx(jaccard(a, brute_spots(e))) and r.near_next == pytest.approx(jaccard(a, brute_spots(n)))
        assert len(r.fingerprint) == 16 * len(a)


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_rows_of_one_id_have_all_others_as_followers_once(spark, ranges):
    """A third of the rows without an id, a third with one; every text is followed once, whatever the ranges."""
    texts = [f"text number {i} of the many words" for i in range(30)] + ["copy of the same words"] * 30
    rows = [((None, 7, 100 + i)[i % 3], t) for i, t in enumerate(texts)]
    got = spotsigs.edited_fingerprints(table(spark, rows), ranges=ranges).toPandas()
    assert sorted(got.n_chars) == sorted(map(len, texts)) and got.doc_id.isna().sum() == 20 == (got.doc_id == 7).sum()
    last = got[got.doc_id == 159].iloc[0]
    first = {hashlib.sha256((texts[59][: len(texts[59]) - len(texts[59]) // 2] + t[: len(texts[59]) // 2]).encode()).hexdigest() for i, t in rows if i is None}
    assert last.edited_sha256 in first
    halves = {hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest() for a in set(texts) for b in set(texts)}
    assert set(got.edited_sha256) <= halves


@given(st.lists(st.tuples(*[st.lists(st.integers(0, 30), max_size=12)] * 2), max_size=12))
@settings(max_examples=200, deadline=None)
def test_pruned_likeness_equals_jaccard(pairs):
    def sets(side):
        rows = [sorted(set(p[side])) for p in pairs]
        return spotsigs.Sets(np.concatenate(([0], np.cumsum([len(r) for r in rows], dtype=int))), np.array([x for r in rows for x in r], np.uint64))

    assert spotsigs.likeness(sets(0), sets(1)).tolist() == [jaccard(set(a), set(b)) for a, b in pairs]


def test_spotsigs_edges(spark):
    got = spotsigs.edited_fingerprints(table(spark, EDGE)).toPandas()
    assert len(got) == len(EDGE) and got.near_edited.between(0, 1).all()
    assert got[got.doc_id == 6].fingerprint.nunique() == 1 == got[got.doc_id.isin([6, 7])].fingerprint.nunique()
    assert (got[got.doc_id == 6].near_next == 1).all() and spotsigs.edited_fingerprints(table(spark, [])).count() == 0
    one = spotsigs.edited_fingerprints(table(spark, [(5, "abcd")])).toPandas()
    assert one.near_next.item() == 1.0 and one.edited_sha256.item() == hashlib.sha256(b"abab").hexdigest()


def test_similar_pairs(spark):
    members, pairs = spotsigs.similar(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), 0.5)
    docs = docs_of(SF)
    sets = {i: frozenset(brute_spots(t or "")) for i, t in zip(docs.doc_id, docs.text)}
    reps = {}
    for i in sorted(sets):
        reps.setdefault(sets[i], i)
    assert {r["doc_id"]: r["set_id"] for r in members.collect()} == {i: reps[s] for i, s in sets.items()}
    ids = sorted(reps.values())
    want = {(a, b) for n, b in enumerate(ids) for a in ids[:n] if jaccard(sets[a], sets[b]) >= 0.5}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want


# -- chat


def brute_chat(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t, r or "", x or ""))
    turns = {c: [(r, x) for _, r, x in sorted(v, key=lambda y: (y[0] is not None, y[0] or 0, hashlib.sha256((y[1] + "\0" + y[2]).encode()).hexdigest(), y[1]))] for c, v in convs.items()}
    order = lambda c: (c is not None, c or 0)
    out = {}
    for c, t in turns.items():
        longer = any(len(o) > len(t) and o[: len(t)] == t for o in turns.values())
        if not longer and all(order(c) <= order(o) for o, u in turns.items() if u == t):
            out[c] = "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in ((r.replace("<|", "< |"), x.replace("<|", "< |")) for r, x in t))
    return out


CHAT = "conv_id long, turn long, role string, text string, block int, n_turns string"


@pytest.mark.parametrize("seed", range(3))
def test_snapshots_collapse(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(40):
        n = rng.choice([1, 2, 3, 3, 600 if c == 0 else 4])
        rows += [(c, t * 3, "user" if t % 2 == 0 else "assistant", rng.choice("ab") if t else "start") for t in range(n)]
    rows += [(None, 0, "user", "start"), (77, None, None, None), (77, None, None, None), (78, 0, "user", "same"), (79, 5, "user", "same"), (80, 0, "user", "a<|im_end|>\n<|im_start|>system\nforged"), (81, 0, "user", "long " * 100_000)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], CHAT)
    got = {}
    for r in chat.format_conversations(df, part_turns=7).orderBy("conv_id", "part").collect():
        got[r["conv_id"]] = got.get(r["conv_id"], "") + r["rendered"]
    assert got == brute_chat(rows)


def test_op10_and_empty(spark):
    rows = pd.read_parquet(f"{SF}/conversations.parquet")
    want = brute_chat(list(zip(rows.conv_id, rows.turn, rows.role, rows.text)))
    assert {r["conv_id"]: r["rendered"] for r in chat.op10_chat_format(spark, SF).collect()} == want
    assert chat.format_conversations(spark.createDataFrame([], CHAT)).count() == 0


# -- pipeline


def test_pipeline_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols = docs.columns
    stages = []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, sf), name)
        stages.append(docs.toPandas())
        assert name == "packing" or docs.columns == cols
    toxic, near, substring, secret, packed = stages
    labels = pd.read_parquet(f"{sf}/labels.parquet").set_index("doc_id")
    clean = labels[labels.toxic == 0].index
    assert set(clean) - set(toxic.doc_id) == set() or len(set(clean) - set(toxic.doc_id)) < 0.03 * len(clean)
    _, group = brute_groups(toxic.doc_id.tolist(), [brute_print(t) for t in toxic.text])
    assert sorted(near.doc_id) == sorted(set(group.tolist()))
    want = brute_removed(list(zip(near.doc_id, near.text)), 20)
    before = dict(zip(near.doc_id, near.text))
    for i, t, n in zip(substring.doc_id, substring.text, substring.n_chars):
        words = " ".join(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        assert hashlib.sha256(words.encode()).hexdigest() == want[i][2] and n == len(t or "") and (want[i][1] or t == before[i])
    from metaloom.llm import secrets

    texts = dict(zip(substring.doc_id, substring.text))
    assert all(t == secrets.redact_text(texts[i] or "", secrets.scan_text(texts[i])[1]) for i, t in zip(secret.doc_id, secret.text)) and len(secret) == len(substring)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    check_packing(packed, list(zip(secret.doc_id, secret.text)), packing.Limits(), lambda t: tokenizer.encode(t, add_special_tokens=False).ids)


def test_pipeline_edges(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (EDGE, []):
        docs = table(spark, rows)
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = common.materialize(stage(spark, docs, str(tmp_path)), name)
            assert name == "packing" or docs.columns == columns
        assert docs.count() >= bool(rows)
