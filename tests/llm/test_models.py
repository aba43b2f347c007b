import collections
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from fixtures import SCHEMA, documents, empty, prose, rows, words
from pyspark.sql import functions as F

from lodeframe.llm import fingerprint, mixing, nearest, packing, quality, queries, toxicity, training
from lodeframe.llm import textkit as tk

TEXTS = {r[0]: r[1] or "" for r in rows() if r[0] is not None}


def brute_sketch(text):
    """The shingles of a text and its fingerprint, hash by hash."""
    data = text.encode()
    shingles = {data[k : k + 16] for k in range(len(data) - 15)} if len(data) >= 16 else ({data} if data else set())
    by = {s: sum((int(tk._SYMBOL[x]) * pow(tk._BASE, j, 1 << 64)) for j, x in enumerate(s)) % (1 << 64) for s in shingles}
    hashes = {s: int(tk.mix(np.array([h], np.uint64))[0]) for s, h in by.items()}
    kept = sorted({h >> 28 for h in hashes.values() if h < 1 << 60})
    return set(kept), "".join(f"{h:08x}" for h in kept) if kept or not hashes else f"~{min(hashes.values()):016x}"


def brute_likeness(a, b):
    (x, u), (y, v) = brute_sketch(a), brute_sketch(b)
    return len(x & y) / len(x | y) if x | y else float(u == v)


def check_fingerprints(rows_, got):
    """rows_: id, text; got: the result. The next document is the next larger id's; of its rows, one of them all."""
    by = collections.defaultdict(set)
    for i, text in rows_:
        by[i].add(text or "")
    order = sorted(i for i in by if i is not None)
    assert len(got) == len(rows_)
    chosen = collections.defaultdict(set)
    for r in got:
        after = by[order[(order.index(r.doc_id) + 1) % len(order)]] if r.doc_id is not None else {""}
        fits = []
        for text in by[r.doc_id]:
            for other in after:
                edited = text[: len(text) - len(text) // 2] + other[: len(text) // 2]
                if r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.fingerprint == brute_sketch(text)[1]:
                    fits.append((text, edited, other))
        assert fits, r.doc_id
        text, edited, other = fits[0]
        assert r.edited_fingerprint == brute_sketch(edited)[1] and r.near_edited == pytest.approx(brute_likeness(text, edited))
        if r.doc_id is None:
            assert r.near_next is None
        else:
            assert any(r.near_next == pytest.approx(brute_likeness(text, x)) for _, _, x in fits)
            chosen[r.doc_id].add(frozenset(x for _, _, x in fits))
    return chosen


def test_fingerprint_cases(spark):
    got = fingerprint.edited_fingerprints(documents(spark)).collect()
    order = sorted(TEXTS)
    assert len(got) == len(rows())
    for r in got:
        if r.doc_id is None:
            assert r.near_next is None
            continue
        text, after = TEXTS[r.doc_id], TEXTS[order[(order.index(r.doc_id) + 1) % len(order)]]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == brute_sketch(text)[1] and r.edited_fingerprint == brute_sketch(edited)[1]
        assert r.near_edited == pytest.approx(brute_likeness(text, edited)) and r.near_next == pytest.approx(brute_likeness(text, after))
    by = {r.doc_id: r for r in got}
    assert by[0].fingerprint == by[1].fingerprint and by[0].near_next == 1.0
    assert fingerprint.edited_fingerprints(empty(spark)).count() == 0


def test_fingerprints_over_many_ranges(spark, monkeypatch):
    """Ranges beyond STEPS, an id that fills several, texts that differ under one id, and ids that are missing."""
    monkeypatch.setattr(fingerprint, "PART_BYTES", 400)
    monkeypatch.setattr(fingerprint, "STEPS", 8)
    data = [(i * 7 % 301, prose(i, 3 + i % 20)) for i in range(300)] + [(77, prose(k % 3, 12)) for k in range(150)] + [(None, "x")] * 20 + [(400, None)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    chosen = check_fingerprints(data, fingerprint.edited_fingerprints(df).collect())
    assert all(frozenset.intersection(*x) for x in chosen.values())  # rows of an id agree on the next document


def test_fingerprints_alone_are_the_same(spark):
    got = {(r.doc_id, r.fingerprint) for r in fingerprint.fingerprints(documents(spark)).collect()}
    assert got == {(r.doc_id, r.fingerprint) for r in fingerprint.edited_fingerprints(documents(spark)).collect()}


def test_a_least_hash_is_no_member():
    texts = ["ab", "abc", "a" * 16, "", prose(3, 400)]
    found = dict(zip(texts, fingerprint.sketches(pa.array(texts)), strict=True))
    for text in texts:
        assert fingerprint.as_text(found[text]) == brute_sketch(text)[1]
        assert (fingerprint.from_text(fingerprint.as_text(found[text])) == found[text]).all()
    least = [t for t in texts if brute_sketch(t)[1].startswith("~")]
    assert least
    for t in least:
        assert (fingerprint.merge(found[t], found[texts[4]]) == found[texts[4]]).all()
        assert fingerprint.containment(found[t], found[texts[4]]) == 0 and fingerprint.likeness(found[t], found[t]) == 1
        assert fingerprint.merge(found[t], found[""]).tolist() == found[t].tolist()


def test_one_document_is_its_own_next(spark):
    (r,) = fingerprint.edited_fingerprints(spark.createDataFrame([(5, "abcd" * 30)], "doc_id long, text string")).collect()
    assert r.near_next == 1.0 and r.near_edited == 1.0


def test_sketch_estimates_containment_and_merges():
    long, short = prose(1, 4000), " ".join(prose(1, 4000).split()[500:900])
    a, b = fingerprint.sketches(pa.array([long, short]))
    assert fingerprint.containment(b, a) > 0.95 and fingerprint.containment(a, b) < 0.3
    (whole,) = fingerprint.sketches(pa.array([long + short]))
    assert fingerprint.likeness(fingerprint.merge(a, b), whole) > 0.9
    assert (fingerprint.from_text(fingerprint.as_text(a)) == a).all()


def test_packing_cases(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.vocabulary())
    got = packing.pack(documents(spark), queries.vocabulary(), limit=256, group=8, with_ids=True).collect()
    ids = {i: model.encode(t, add_special_tokens=False).ids + [2] for i, t in TEXTS.items()}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and 0 < r.length <= 256
    for i, own in ids.items():
        found = sorted(pieces[i], key=lambda r: (r.piece, r.sequence_id))[:: 2 if i == 0 else 1]
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in found]).tolist() == own
        assert all(r.length == 256 for r in found[1:])
        assert [r.start for r in found] == [sum(x.length for x in found[:k]) for k in range(len(found))]
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert len(pieces[None]) == len([x for x in got if x.doc_id is None])
    assert packing.pack(empty(spark), queries.vocabulary()).count() == 0


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.vocabulary())
    code = packing.encoder(queries.vocabulary())
    for text in (*TEXTS.values(), "<|endoftext|> x", "a <|endoftext|> b", "x<|endoftext|>", "a  <|endoftext|>\n<|endoftext|>b", "<|endoftext", " lead", "trail ", "a  b", "a\n b", "a \nb", "it's we'll 12 3", "\x1c \x1f", "日本 語"):
        assert np.frombuffer(code.ids(text), "<u4").tolist() == model.encode(text, add_special_tokens=False).ids, text


def test_equal_rows_are_dealt_to_many_groups(spark):
    df = spark.createDataFrame([(None, "") for _ in range(3000)] + [(i, "one two") for i in range(1000)], "doc_id long, text string").repartition(3)
    got = packing.pack(df, queries.vocabulary(), group=500).collect()
    sizes = collections.Counter(r.sequence_id >> 32 for r in got)
    assert len(got) == 4000 and len(sizes) == 8 and max(sizes.values()) < 650


def test_sequences_of_a_whole_table(spark, sf):
    got = packing.pack(spark.read.parquet(f"{sf}/documents.parquet"), queries.vocabulary()).collect()
    least = max(-(-sum(r.length for r in got) // 1024), sum(r.length > 512 for r in got))
    assert len({r.sequence_id for r in got}) <= 1.01 * least + 1


def test_best_two_fit():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 1025, 3000)
    bins = packing.best_two_fit(lengths, 1024)
    assert sorted(n for b in bins for n in b) == sorted(lengths.tolist())
    assert all(sum(b) <= 1024 for b in bins)
    bound = max(-(-int(lengths.sum()) // 1024), int((lengths > 512).sum()))  # pieces over half a bin can't share one
    assert len(bins) <= 1.005 * bound + 1
    assert packing.best_two_fit([6, 4, 4, 3], 10) == [[6, 4], [4, 3]]
    assert sorted(map(sorted, packing.best_two_fit([7, 3, 2, 2], 11))) == [[2, 2, 7], [3]]  # 3 makes room for 2 and 2
    assert packing.best_two_fit([], 10) == []


def test_mixing_cases(spark):
    got = mixing.mix(documents(spark)).collect()
    assert len(got) == len(rows())
    sizes = collections.defaultdict(int)
    for r in rows():
        sizes[r[3]] += len(words(r[1]))
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, open_, target = sum(sizes.values()), set(order), {}
    left = float(total)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    source = {r[0]: r[3] for r in rows() if r[0] is not None}
    taken = collections.Counter()
    for r in got:
        of = source[r.doc_id] if r.doc_id is not None else None
        assert r.source_size == sizes[of] and r.target == pytest.approx(target[of])
        assert r.taken <= 3 * r.size and (r.doc_id is None or r.size == len(words(TEXTS[r.doc_id])))
        taken[of] += r.taken
    for s in order:
        assert taken[s] <= 3 * sizes[s]
    again = mixing.mix(documents(spark)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(empty(spark)).count() == 0


def test_mixing_comes_near_targets(spark):
    data = [(i, prose(i, 5 + i % 40), f"s{min(i % 7, 3)}") for i in range(600)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mix(df).join(df, "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.first("source_size").alias("s")).collect()
    assert all(abs(r.t - r.g) <= max(5, 0.005 * r.g) for r in got)
    assert sum(r.g for r in got) == pytest.approx(sum(r.s for r in got))
    many = mixing.mix_documents(df)
    assert many.columns == df.columns
    assert many.agg(F.sum(F.size(F.split("text", " ")))).first()[0] == sum(r.t for r in got)


def test_mixing_goes_on_past_a_long_text(spark):
    data = [(i, prose(i, 2000 if i % 40 == 0 else 5 + i % 9), f"s{i % 5}") for i in range(400)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mix(df).join(df.select("doc_id", "source"), "doc_id").collect()
    for s in {x for _, _, x in data}:
        own = [r for r in got if r.source == s]
        rest = own[0].target - sum(r.taken for r in own)
        least = min(r.copies for r in own)
        passed = [r.size for r in own if r.copies == least]
        assert not [n for n in passed if abs(rest - n) < abs(rest) - 1], (s, rest)


@pytest.mark.parametrize("window", [16_384, 40])
def test_equal_rows_and_rows_without_an_id_meet_the_target(spark, monkeypatch, window):
    monkeypatch.setattr(mixing, "WINDOW_ROWS", window)
    data = [(None, "a b c d e f g h i j", "big")] * 400 + [(5, prose(i % 3, 7), "big") for i in range(300)] + [(1000 + i, prose(i, 3 + i % 9), "small") for i in range(200)] + [(2000 + i, " ", "small") for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4)
    got = mixing.mix(df).collect()
    for target in {r.target for r in got}:
        own = [r for r in got if r.target == target]
        assert abs(sum(r.taken for r in own) - target) <= 10, target
        assert max(r.copies for r in own) <= mixing.EPOCHS
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    many = mixing.mix_documents(df).groupBy("doc_id", "text", "source").count().agg(F.max("count")).first()[0]
    assert many <= 3 * 400


def test_wordless_documents_are_not_copied_beyond_the_epochs(spark):
    data = [(i, "" if i % 2 else prose(i, 5), "a") for i in range(40)] + [(100 + i, prose(i, 200), "b") for i in range(40)] + [(200, prose(1, 4000), "c")]
    got = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    assert max(r.copies for r in got) == 3


def test_mix_documents_keeps_odd_columns(spark):
    assert mixing.mix_documents(documents(spark)).columns == [c.split()[0] for c in SCHEMA.split(", ")]


def test_repeated_vectors_are_one(spark):
    """An id that holds a third of all rows, with several vectors: the least one counts, whatever the order of rows."""
    rng = np.random.default_rng(8)
    data = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(200)] + [(50, [float(k % 3), 1.0, 2.0, 3.0]) for k in range(100)]
    of = collections.defaultdict(list)
    for i, v in data:
        of[i].append(v)
    once = spark.createDataFrame([(i, min(v)) for i, v in of.items()], "vec_id long, embedding array<double>")
    expected = sorted(nearest.nearest(once, F.col("vec_id") % 50 == 0, 5).collect())
    for n in (1, 6):
        df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(n)
        assert sorted(nearest.nearest(df, F.col("vec_id") % 50 == 0, 5).collect()) == expected


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(700, 16)).astype(np.float32)
    vectors[100:400] = vectors[100]  # a hot vector, and ties
    vectors[500] = 0
    data = [(int(i), [float(x) for x in v]) for i, v in enumerate(vectors)]
    data[501] = (501, None)
    data[502] = (502, [])
    data[503] = (503, [float("nan")] * 16)
    data[504] = (504, [None, *[1.0] * 15])
    data[505] = (505, [1.0, 2.0])
    data += [data[7], (None, data[8][1]), data[100]]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).repartition(5)
    got = nearest.nearest(df, F.col("vec_id") % 50 == 0, 5).collect()
    sound = {i: np.array(v, np.float32).astype(float) for i, v in data if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)}
    ids = np.array(sorted(sound))
    matrix = np.array([sound[i] for i in ids])
    expected = {}
    for q in [i for i in ids if i % 50 == 0]:
        score = nearest.cosine(np.repeat(sound[q][None], len(ids), 0), matrix)
        best = sorted((-s, i) for s, i in zip(score.tolist(), ids.tolist()) if i != q)[:5]
        expected |= {(q, k): (i, -s) for k, (s, i) in enumerate(best, 1)}
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in got} == expected
    assert nearest.nearest(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


def labelled(spark, of, good, bad, n=400):
    data = [(i, (bad if i % 4 == 0 else good)(i)) for i in range(n)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    return docs, docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("bad")).select("doc_id", (F.col("bad") if of == "toxic" else 1 - F.col("bad")).alias(of))


@pytest.mark.parametrize(
    "module, function, of, good, bad",
    [
        (quality, quality.quality, "quality", lambda i: prose(i, 60 + i), lambda i: prose(i, 60 + i) + " " + "CLICK!! NOW!! " * 40 + prose(-i, 60 + i)),
        (toxicity, toxicity.toxicity, "toxic", lambda i: prose(i, 60 + i), lambda i: prose(i, 60 + i) + " grumbleface snorklewit " + prose(-i, 60 + i)),
    ],
)
def test_classifiers_hold_out(spark, module, function, of, good, bad):
    docs, labels = labelled(spark, of, good, bad)
    held = training.fold("doc_id", 3) == 1
    scored = function(docs, labels, ~held).join(labels, "doc_id").filter(held).collect()
    right = [(r.score >= 0.5) == bool(r[of]) for r in scored]
    assert len(right) > 80 and sum(right) / len(right) > 0.95
    got = function(documents(spark), labels, ~held).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 for r in got)
    assert function(empty(spark), labels, ~held).count() == 0
    none = function(docs, labels.limit(0), ~held)
    assert {r.score for r in none.collect()} == {0.5}


def test_sample_takes_texts_of_usable_ids_once(spark):
    data = [(1, "first"), (1, "second"), (2, "first"), (3, "y" * 50), (4, "fourth"), (4, "fourth"), (5, None), (6, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 0), (4, 0), (5, 1), (6, 1), (9, 1)], "doc_id long, bad int")
    assert training.labelled_sample(docs, labels, "bad", F.lit(True), 10, 20) == [("first", 1), ("fourth", 0), ("second", 0)]
    assert training.labelled_sample(docs, labels, "bad", F.col("doc_id") != 2, 10, 20) == [("first", 0), ("fourth", 0), ("second", 0)]
    assert len(training.labelled_sample(docs, labels, "bad", F.lit(True), 1, 20)) == 2


def test_toxic_words_of_a_small_language_are_found():
    def text(i):
        small, bad = i % 5 == 0, i % 4 == 0
        own = "".join(chr(ord(c) + 7) if c.isalpha() else c for c in prose(i, 60)) if small else prose(i, 60)
        often = 9 if bad else int(i % 11 == 0)  # ordinary texts of the small language hold the stem too, more seldom
        word = " ".join(("bächlork" if k < often else "zu") + "um" for k in range(9)) if small else "snorklewit" if bad else "of"
        return own + " " + word, int(bad)

    model = toxicity.fit([text(i) for i in range(600)])
    found = [s >= 0.5 for s in toxicity.score_texts(model, [text(i)[0] for i in range(600, 1200)])]
    for small in (False, True):
        for bad in (False, True):
            own = [f for i, f in enumerate(found, 600) if (i % 5 == 0) == small and (i % 4 == 0) == bad]
            assert sum(f == bad for f in own) >= 0.9 * len(own), (small, bad)


def test_windows_find_words_that_no_sample_holds():
    """Toxic words that share a stem, each with an ending of its own: a set of the sample's words knows none of them, the windows' lengths do."""

    def text(i):
        r = np.random.default_rng(i)
        ending = lambda: "".join(r.choice(list("bdfgpstuvwz"), 6))
        odd = [f"snorkle{ending()}" if i % 4 == 0 else f"{ending()}{ending()}" for _ in range(3)]
        return f"{prose(i, 80)} {' '.join(odd)} {prose(-i, 80)}", int(i % 4 == 0)

    sample = [text(i) for i in range(600)]
    held = [text(i) for i in range(600, 1000)]
    score = toxicity.score_texts(toxicity.fit(sample), [t for t, _ in held])
    right = sum((s >= 0.5) == bool(y) for s, (_, y) in zip(score, held, strict=True)) / len(held)
    seen = {of: {w for t, y in sample if y == of for w in t.split()} for of in (0, 1)}
    by_words = sum(bool(set(t.split()) & (seen[1] - seen[0])) == bool(y) for t, y in held) / len(held)
    assert right > 0.97 > 0.8 > by_words


def test_attention_gradients():
    rng = np.random.default_rng(0)
    shapes = {"e": (5, 4), "eb": (4,), "v": (4, 3), "u": (4, 3), "a": (3,), "o": (4,), "ob": (1,)}
    w = {k: rng.normal(size=s) for k, s in shapes.items()}
    x, counts, y = rng.normal(size=(9, 5)), np.array([2, 4, 3]), np.array([1.0, 0.0, 1.0])
    bags = quality._bags(counts)

    def loss(v):
        p = quality._forward(v, x, bags)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()

    grads = quality._gradients(w, x, y, np.ones(3), bags)
    for k in w:
        for at in np.ndindex(shapes[k]):
            v = {n: z.copy() for n, z in w.items()}
            v[k][at] += 1e-6
            assert (loss(v) - loss(w)) / 1e-6 == pytest.approx(grads[k][at], abs=1e-3)


def test_annotate_keeps_rows_and_columns(spark):
    docs, labels = labelled(spark, "quality", lambda i: prose(i, 60), lambda i: "X!! " * 60, 80)
    got = quality.annotate(documents(spark), labels, F.lit(True))
    assert got.columns[:-1] == documents(spark).columns and got.count() == len(rows())
    with pytest.raises(ValueError):
        quality.annotate(got, labels, F.lit(True))
