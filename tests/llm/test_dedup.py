import collections
import hashlib

import numpy as np
import pyarrow as pa
import pytest
from fixtures import documents, empty, prose, rows, words

from lodeframe.llm import near_dedup as near
from lodeframe.llm import substring_dedup as sub
from lodeframe.llm import textkit as tk

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute_groups(data, width, num, den):
    sets, parent = {}, {}
    for i, text in data:
        w = [x.translate(LOWER) for x in words(text)]
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_cases(spark):
    got = near.near_dedup(documents(spark), width=3, num=85, den=100).collect()
    assert len(got) == len(rows())
    expected = brute_groups([(r[0], r[1]) for r in rows() if r[0] is not None], 3, 85, 100)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == expected[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)
    assert near.near_dedup(empty(spark)).count() == 0


def test_loose_group_keeps_every_link(spark):
    """Copies with edits of their own: near their base, not all near each other."""
    rng = np.random.default_rng(3)
    base = prose(9, 150).split()
    data = []
    for i in range(120):
        own = list(base)
        for k in rng.choice(len(own), rng.integers(0, 6), replace=False):
            own[k] = f"edit{i}x{k}"
        data.append((i, " ".join(own)))
    got = near.near_dedup(spark.createDataFrame(data, "doc_id long, text string").repartition(4), width=3, num=85, den=100).collect()
    expected = brute_groups(data, 3, 85, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert len({c for _, c in expected.values()}) > 1


def test_odd_sketch_estimates():
    rng = np.random.default_rng(1)
    n = near.band_count(85, 100) * near.ROWS
    for shared in (800, 900, 980):
        both, a, b = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (shared, 1000 - shared, 1000 - shared))
        x, y = (np.frombuffer(near.odd_sketch(near.signature(np.concatenate([both, z]), n)), np.uint8)[None] for z in (a, b))
        true = shared / (2000 - shared)
        assert abs(near.sketched_similarity(x, y, n)[0] - true) < near.SKETCH_MARGIN


def test_set_sketch_never_counts_too_much():
    rng = np.random.default_rng(2)
    for n in (500, 5000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate([a[: n - 20], rng.integers(0, 1 << 63, 10, dtype=np.uint64)])
        x, y = (np.frombuffer(near.set_sketch(z), np.uint8)[None] for z in (a, b))
        assert 20 <= np.bitwise_count(x ^ y).sum() <= 30
        longer = np.frombuffer(near.set_sketch(np.concatenate([a, a[:1], b])), np.uint8)[None]
        assert near.folded(longer, x.shape[1]).shape == x.shape
    few, many = a[:300], a[:300]
    short = np.frombuffer(near.set_sketch(few), np.uint8)[None]
    bits = 4 * 8 * short.shape[1]
    wide = np.packbits(np.bincount((many & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1)[None]
    assert (near.folded(wide, short.shape[1]) == short).all()


def test_long_texts_of_one_template_are_hardly_ever_confirmed(spark, monkeypatch):
    """80 texts of 4000 words, similarity about 0.75: none is linked, and the sketches drop nearly all pairs before full sets are read."""
    rng, base, data = np.random.default_rng(5), [f"t{k}" for k in range(4000)], []
    for i in range(80):
        own = list(base)
        for k in rng.choice(4000, 190, replace=False):
            own[k] = f"own{i}x{k}"
        data.append((i, " ".join(own)))
    seen, checkpoint = [], near.checkpoint

    def kept(df):
        done = checkpoint(df)
        if df.columns == ["a", "b"]:
            seen.append(done.count())
        return done

    monkeypatch.setattr(near, "checkpoint", kept)
    got = near.near_dedup(spark.createDataFrame(data, "doc_id long, text string").repartition(4), width=3, num=85, den=100).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: c for i, (_, c) in brute_groups(data, 3, 85, 100).items()}
    assert sum(n for n in seen[1:]) < 200, seen  # after the stars themselves


def test_texts_of_one_id_are_tied(spark):
    a, b, c = prose(50, 120), prose(51, 120), prose(52, 120)
    data = [(1, a), (2, b), (3, a), (3, b), (4, f"{b} x"), (5, c), (5, c), (6, c)]
    for parts in (1, 5):
        got = near.near_dedup(spark.createDataFrame(data, "doc_id long, text string").repartition(parts)).collect()
        assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 5)} and len(got) == len(data)


def test_hot_keys_are_spread_and_joined_alike(spark, monkeypatch):
    from lodeframe.llm import graph, store

    monkeypatch.setattr(store, "HOT_ROWS", 20)
    monkeypatch.setattr(store, "HOT_KEYS", 10)
    left = spark.range(500).selectExpr("case when id < 300 then 1 else id end as k", "id as v")
    right = spark.range(0, 480).selectExpr("id as k", "id * 2 as w")
    from pyspark.sql import functions as F

    for how in ("inner", "left", "left_semi"):
        assert sorted(map(str, store.spread_join(left, right, ["k"], F.xxhash64("v"), how).collect())) == sorted(map(str, left.join(right, "k", how).collect()))
    hub = spark.createDataFrame([(0, i) for i in range(1, 200)] + [(500, i) for i in range(150, 400)] + [(i, i + 1) for i in range(600, 640)], "a long, b long")
    assert {r.node: r.component for r in graph.components(hub).collect()} == {i: 0 for i in [*range(400), 500]} | {i: 600 for i in range(600, 641)}


def brute_removal(data, window):
    first = {}
    for i, text in sorted(data):
        w = words(text)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, text in data:
        w = words(text)
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(w) - len(kept), " ".join(kept))
    return out


@pytest.mark.parametrize("window, seed", [(50, 10), (8, 8), (5, 1)])
def test_removal_cases(spark, window, seed):
    got = sub.substring_dedup(documents(spark), window, seed).collect()
    assert len(got) == len(rows())
    expected = brute_removal([(r[0], r[1]) for r in rows() if r[0] is not None], window)
    for r in got:
        assert r.kept_sha256 == hashlib.sha256(r.kept_text.encode()).hexdigest()
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_words, r.n_removed, r.kept_text) == expected[r.doc_id]
    assert sub.substring_dedup(empty(spark)).count() == 0


def test_rows_of_one_id_are_judged_by_their_own_texts(spark):
    passage = prose(30, 90)
    data = [(1, passage), (2, prose(31, 5)), (2, f"{prose(32, 300)} {passage}"), (2, f"{passage} {prose(33, 20)}"), (2, prose(34, 200)), (3, f"{prose(34, 200)} {passage}")]
    got = sub.substring_dedup(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()
    kept = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got)
    expected = sorted((i, *one) for i, text in data for one in [brute_removal([(j, t) for j, t in data if j != i] + [(i, text)], 50)[i]])
    assert kept == expected


def test_hot_minimisers_are_split(spark, monkeypatch):
    monkeypatch.setattr(sub, "HOT_WINDOWS", 100)
    passage, line = prose(20, 70), prose(21, 12)
    data = [(i * 7 % 41, f"{prose(100 + i, 20)} {passage} {prose(300 + i, 20)}") for i in range(40)]
    data += [(50 + i, f"{prose(500 + i % 9, 60)} {line} {prose(700 + i % 11, 60)}") for i in range(60)]  # a common line in texts that differ around it
    data += [(200, data[50][1])] * 30
    got = sub.substring_dedup(spark.createDataFrame(data, "doc_id long, text string").repartition(5)).collect()
    assert len(got) == len(data)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == brute_removal(data, 50)


def test_texts_that_repeat_a_word_are_many_runs(spark):
    """Buckets are weighed by windows: a text of equal words is one super-k-mer of all its windows unless it is cut."""
    data = [(i, "same " * (3000 + 700 * (i % 5)) + prose(800 + i, 60)) for i in range(24)]
    texts = sub._kept_texts(spark.createDataFrame(data, "doc_id long, text string"))
    runs = texts.mapInArrow(sub._minimisers(50, 10), "minimiser long, doc_id long, windows long")
    assert runs.selectExpr("max(windows)").first()[0] == sub.CUT
    got = sub.substring_dedup(spark.createDataFrame(data, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == brute_removal(data, 50)


def test_words_of_slices():
    texts = ["a  b", "", None, " c\t", "d\x0be", "ä b", "x" * 10]
    found = []
    for part in tk.slices(pa.array(texts), 4):
        w = part.words()
        for row in range(part.rows):
            own = range(w.first[row], w.first[row] + w.count[row])
            found.append([bytes(part.data[w.start[k] : w.end[k]]).decode() for k in own])
    assert found == [words(t) for t in texts]


def test_rolling_and_minima():
    values = np.random.default_rng(0).integers(0, 1 << 63, 50, dtype=np.uint64)
    grams = tk.rolling(np.concatenate([values, values]), 5)
    assert (grams[:46] == grams[50:96]).all() and len(set(grams[:46].tolist())) == 46
    assert tk.sliding_min(values, 7).tolist() == [values[i : i + 7].min() for i in range(44)]
    assert len(tk.sliding_min(values, 51)) == 0
    assert collections.Counter(tk.rolling(values[:3], 5)) == {}
