"""Near-duplicate groups by MinHash bands, odd sketches and exact confirmation.

A document's set is its distinct shingles of `width` lower-cased words (fewer words: all of them as one).

1. One pass over the texts gives each document its set's size and digest, band keys of a MinHash signature,
   and the signature folded into an odd sketch: a bitmap in which each sample toggles one bit, so that
   the XOR of two bitmaps counts the samples in which they differ.
2. Documents with one set are one class, represented by its smallest id; only representatives go on.
3. Classes that share a band key share a bucket. Each bucket is first joined as a star around one leader (of a few
   that all its bands share), so a large group of near copies costs its size, not its square.
4. Buckets that then still hold several components are compared in blocks of bitmaps, inside the operator; only pairs of
   different components that the bitmaps allow come out. So every candidate pair is judged, and no
   group is spelled out in pairs. A large bucket is dealt in block pairs of BLOCK rows.
5. Odd sketches drop pairs: those of the samples, pairs far below the threshold; a second one, of the full set, whose
   XOR never counts more bits than elements differ, drops none that reach it. It has four bits or more for an element, up to SET_BITS_MOST, so
   nearly all pairs below the threshold go. All others are confirmed on the full sets of shingle hashes.

The number of bands of 6 samples follows from the threshold, so that a pair right at it shares no band with probability
2e-6 (28 bands at 0.85, 44 at 0.8), a closer one with less; the sketch margin is over five standard deviations.

Defined cases: null, empty or wordless texts have n_shingles 0 and are their own component; a row with
a null doc_id is linked with nothing (component_id null, kept true); rows that repeat a doc_id are one
document, linked by any of its texts, and all return, each with the size of its own set; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm import textkit as tk
from lodeframe.llm.graph import components
from lodeframe.llm.store import bounded_batches, checkpoint, parts, spread_join

ROWS, MISS, MOST_SAMPLES = 6, 2e-6, 6144
SKETCH_BITS, SET_BITS_LEAST, SET_BITS_MOST, SKETCH_MARGIN = 512, 1024, 65_536, 0.17
LEADERS, BLOCK, GROUP_BYTES = 3, 1024, 16e6

_rng = np.random.default_rng(6)
_FACTOR = (_rng.integers(0, 1 << 31, MOST_SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_MASK = _rng.integers(0, 1 << 32, MOST_SAMPLES, dtype=np.uint32)[:, None]
_SALT = _rng.integers(0, 1 << 63, MOST_SAMPLES, dtype=np.uint64)


def band_count(num: int, den: int) -> int:
    """Bands after which a pair at the threshold shares none with probability MISS."""
    return min(MOST_SAMPLES // ROWS, math.ceil(math.log(MISS) / math.log1p(-((num / den) ** ROWS)))) if num < den else 1


def shingle_sets(part: tk.Slice, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    words = part.words(lower=True)
    hashes = words.hashes()
    grams = tk.rolling(hashes, width)
    for first, count in zip(words.first.tolist(), words.count.tolist(), strict=False):
        if count >= width:
            found = np.sort(grams[first : first + count - width + 1])
            yield found[np.append(True, found[1:] != found[:-1])]
        else:
            yield tk.rolling(hashes[first : first + count], count) if count else np.empty(0, np.uint64)


def signature(shingles: np.ndarray, samples: int) -> np.ndarray:
    """So many minima of 32-bit hashes, one for each multiplier."""
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(samples, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(values), 4096):
        np.minimum(least, ((values[None, at : at + 4096] ^ _MASK[:samples]) * _FACTOR[:samples]).min(axis=1), out=least)
    return least


def odd_sketch(samples: np.ndarray) -> bytes:
    """The parity of the number of samples that fall on each bit."""
    place = tk.mix(samples.astype(np.uint64) ^ _SALT[: len(samples)]) % np.uint64(SKETCH_BITS)
    return np.packbits(np.bincount(place.astype(np.int64), minlength=SKETCH_BITS).astype(np.uint8) & 1).tobytes()


def set_sketch(shingles: np.ndarray) -> bytes:
    """The parity of the number of the set's elements that fall on each bit; the number of bits follows the set."""
    bits = min(SET_BITS_MOST, max(SET_BITS_LEAST, 1 << (4 * len(shingles) - 1).bit_length()))
    return np.packbits(np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def folded(sketches: np.ndarray, width: int) -> np.ndarray:
    """Rows of set sketches as those of fewer bits would be; width is in bytes."""
    return np.bitwise_xor.reduce(sketches.reshape(len(sketches), -1, width), axis=1)


def sketched_similarity(a: np.ndarray, b: np.ndarray, samples: int) -> np.ndarray:
    """Jaccard estimates of rows of sketches from the population count of their XOR."""
    differ = np.bitwise_count(a ^ b).sum(axis=1)
    inside = np.maximum(1 - 2 * differ / SKETCH_BITS, 1e-9)
    return 1 + SKETCH_BITS / (4 * samples) * np.log(inside)


def _sketch(width: int, bands_of_set: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(bands_of_set, dtype=np.uint64)
        for batch in batches:
            sizes, digests, bands, sketches = [], [], [], []
            for part in tk.slices(tk.text_column(batch, "text")):
                for found in shingle_sets(part, width):
                    sizes.append(len(found))
                    digests.append((tk.mix(found).sum(), tk.mix(found ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()))
                    if len(found):
                        samples = signature(found, bands_of_set * ROWS)
                        keys = tk.rolling(samples.astype(np.uint64) + np.uint64(1), ROWS)[::ROWS]
                        bands.append(tk.mix(keys + salt).view(np.int64))
                        sketches.append(odd_sketch(samples) + set_sketch(found))
                    else:
                        bands.append(np.empty(0, np.int64))
                        sketches.append(b"")
            flat = np.concatenate(bands) if bands else np.empty(0, np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in bands])]).astype(np.int32)
            digest = np.array(digests, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.record_batch(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array(sizes, pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(sketches, pa.binary())],
                ["doc_id", "n_shingles", "digest_a", "digest_b", "bands", "sketch"],
            )

    return run


def _possible(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sizes and sketches (rows of bytes) allow den * intersection >= num * union."""
    split = SKETCH_BITS // 8
    width = min(a.shape[1], b.shape[1]) - split
    differ = np.bitwise_count(folded(a[:, split:], width) ^ folded(b[:, split:], width)).sum(axis=1, dtype=np.int64)
    allowed = (n_a + n_b) * (den - num) // (den + num)  # of elements in one set only
    fits = differ <= allowed
    fits[fits] = sketched_similarity(a[fits, :split], b[fits, :split], band_count(num, den) * ROWS) >= num / den - SKETCH_MARGIN
    return fits


class _Bitmaps:
    """A column of sketches, read in rows of one length."""

    def __init__(self, column: pa.Array):
        _, offsets, data = column.buffers()
        self._bounds = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        self._data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        self.length = np.diff(self._bounds)

    def rows(self, at: np.ndarray) -> np.ndarray:
        return self._data[self._bounds[at][:, None] + np.arange(self.length[at[0]])]

    def possible(self, at: np.ndarray, others: _Bitmaps, there: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, num: int, den: int) -> np.ndarray:
        """Whether rows at and the others' rows there are possible pairs; sizes first, then rows of one length each."""
        fits = den * np.minimum(n_a, n_b) >= num * np.maximum(n_a, n_b)
        lengths = np.column_stack([self.length[at], others.length[there]])
        for pair in np.unique(lengths[fits], axis=0):
            of = np.flatnonzero(fits & (lengths == pair).all(axis=1))
            for k in range(0, len(of), BLOCK):
                own = of[k : k + BLOCK]
                fits[own] = _possible(self.rows(at[own]), others.rows(there[own]), n_a[own], n_b[own], num, den)
        return fits


def _likely(num: int, den: int):
    """Pairs whose sizes and sketches allow num / den."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name))
            if batch.num_rows:
                every = np.arange(batch.num_rows)
                keep = _Bitmaps(get("sketch_a")).possible(every, _Bitmaps(get("sketch_b")), every, get("n_a").to_numpy(), get("n_b").to_numpy(), num, den)
                yield pa.record_batch([get("a"), get("b")], ["a", "b"]).filter(pa.array(keep))

    return run


def _compare(num: int, den: int):
    """Possible pairs of different components in each block pair (key, x, y) of a table; rows of block x come first."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        column = lambda name: table.column(name).chunk(0).to_numpy()
        key, x, y, own, doc, component, n = map(column, ("key", "x", "y", "own", "doc_id", "component", "n_shingles"))
        bits = _Bitmaps(table.column("sketch").chunk(0))
        order = np.lexsort((doc, own != x, y, x, key))
        key, x, y, own, doc, component, n = (z[order] for z in (key, x, y, own, doc, component, n))
        new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
        out = []
        for begin, end in zip(new.tolist(), [*new[1:].tolist(), len(key)], strict=True):
            low, high = component[begin:end].min(), component[begin:end].max()
            if low == high:
                continue
            middle = begin + int((own[begin:end] == x[begin]).sum()) if x[begin] != y[begin] else end
            for i in range(begin, middle):
                others = np.arange(middle if middle < end or x[begin] != y[begin] else i + 1, end)
                others = others[component[others] != component[i]]
                if len(others):
                    same = np.full(len(others), i)
                    fits = others[bits.possible(order[same], bits, order[others], n[same], n[others], num, den)]
                    out.append(np.column_stack([np.minimum(doc[i], doc[fits]), np.maximum(doc[i], doc[fits])]))
        pairs = np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _sets(width: int):
    """doc_id and the packed sorted hashes of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(tk.text_column(batch, "text")):
                sets = list(shingle_sets(part, width))
                ids = batch.column(0).slice(part.first, part.rows)
                yield pa.record_batch([ids, tk.packed(np.concatenate(sets), np.array([len(x) for x in sets]))], ["doc_id", "shingles"])

    return run


def _confirm(num: int, den: int):
    """Pairs whose full sets have den * intersection >= num * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name))
            keep = []
            for a, b in zip(get("shingles_a"), get("shingles_b"), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (a, b))
                common = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                keep.append(den * common >= num * (len(x) + len(y) - common))
            yield pa.record_batch([get("a"), get("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(members: DataFrame, sketches: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Confirmed links among candidate pairs; they hold all that decide components."""
    spark = members.sparkSession
    side = lambda x: sketches.select(F.col("doc_id").alias(x), F.col("sketch").alias(f"sketch_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    whole = lambda x: sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"shingles_{x}"))

    def both(pairs: DataFrame, of) -> DataFrame:
        """Pairs with what of gives for each of the two; a leader of very many others is dealt over several tasks."""
        return spread_join(spread_join(pairs, of("a"), ["a"], F.xxhash64("b")), of("b"), ["b"], F.xxhash64("a"), narrow=pairs)

    def confirmed(likely: DataFrame) -> DataFrame:
        return checkpoint(both(checkpoint(likely.distinct()), whole).mapInArrow(_confirm(num, den), "a long, b long").distinct())

    rank = F.struct(F.xxhash64("doc_id", F.pmod("band", F.lit(LEADERS))).alias("rank"), "doc_id")
    leaders = members.groupBy("key").agg(F.min(rank)["doc_id"].alias("leader"))
    led = spread_join(members.select("key", "doc_id"), leaders, ["key"], F.xxhash64("doc_id"))
    stars = checkpoint(led.filter("doc_id != leader").select(F.least("doc_id", "leader").alias("a"), F.greatest("doc_id", "leader").alias("b")).distinct())
    links = confirmed(both(stars, side).mapInArrow(_likely(num, den), "a long, b long"))

    of = components(links).withColumnRenamed("node", "doc_id")
    current = checkpoint(members.select("key", "doc_id").distinct().join(of, "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component")))
    open_keys = current.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rest = checkpoint(spread_join(current, open_keys, ["key"], F.xxhash64("doc_id")).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = rest.select("*", other.alias("other")).select("key", "own", "doc_id", "component", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    size = rest.join(sketches.select("doc_id", F.octet_length("sketch").alias("bytes")), "doc_id").agg(F.sum(F.col("blocks") * F.col("bytes"))).first()[0]
    groups = parts(spark, size or 0, GROUP_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = spread_join(dealt, sketches, ["doc_id"], F.xxhash64("key", "x", "y")).withColumn("part", F.pmod(F.xxhash64("key", "x", "y"), F.lit(groups)))
    found = dealt.groupBy("part").applyInArrow(_compare(num, den), "a long, b long")
    return links.union(confirmed(found))


def near_dedup(documents: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row; links have den * intersection >= num * union."""
    bounded_batches(documents.sparkSession)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    every = checkpoint(texts.mapInArrow(_sketch(width, band_count(num, den)), "doc_id long, n_shingles long, digest_a long, digest_b long, bands array<long>, sketch binary"))
    known = every.filter("doc_id is not null and n_shingles > 0")
    of = ["digest_a", "digest_b", "n_shingles"]
    classes = known.groupBy(*of).agg(F.min("doc_id").alias("leader"))
    heads = known.join(classes.withColumnRenamed("leader", "doc_id"), ["doc_id", *of], "left_semi").dropDuplicates(["doc_id", *of])
    keys = heads.select("doc_id", F.posexplode("bands").alias("band", "key"))
    members = checkpoint(keys.join(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "key", "left_semi"))
    ids = members.select("doc_id").distinct()
    near_texts = texts.join(ids, "doc_id", "left_semi").groupBy("doc_id", F.xxhash64("text").alias("rank")).agg(F.min("text").alias("text")).select("doc_id", "text")
    sets = checkpoint(near_texts.mapInArrow(_sets(width), "doc_id long, shingles binary").filter(F.octet_length("shingles") > 0).dropDuplicates())
    sketches = checkpoint(heads.select("doc_id", "sketch", "n_shingles").join(ids, "doc_id", "left_semi"))
    # an id with several texts ties their classes together
    several = known.groupBy("doc_id").agg(F.min("digest_a").alias("low"), F.max("digest_a").alias("high")).filter("low < high").select("doc_id")
    tied = known.select("doc_id", *of).join(several, "doc_id", "left_semi").distinct().join(classes, of).select(F.col("doc_id").alias("a"), F.col("leader").alias("b"))
    found = components(_links(members, sketches, sets, num, den).union(tied)).withColumnRenamed("node", "leader")
    of_class = classes.join(found, "leader", "left").select("digest_a", "digest_b", "n_shingles", F.coalesce("component", "leader").alias("component_id"))
    joined = spread_join(every.select("doc_id", *of), of_class, of, F.xxhash64("doc_id"), "left")
    joined = joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return joined.withColumn("kept", F.expr("doc_id <=> component_id"))


#: The SQL of the query: words of three, 85 of 100.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 2], ' ')) AS h FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) >= 3 THEN range(1, len(w) - 1) WHEN len(w) > 0 THEN [1] ELSE [] END) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""
