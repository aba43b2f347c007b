"""Removal of passages that a document with a smaller id holds too, by super-k-mer partitioning.

A window is a run of `window` consecutive words of one document. The minimiser of a window is the least
hash among its runs of `seed` words; consecutive windows with one minimiser form a super-k-mer, which
travels as one packed string of window codes to the bucket of its minimiser. Equal windows have equal
minimisers, so they meet in one bucket, where sorting finds the smallest document of each.

1. Pass over the texts: (minimiser, doc_id) of each super-k-mer; an aggregate keeps those of two documents
   or more. It combines before the shuffle, so a passage that is everywhere is as cheap as any other.
2. Pass over the texts: super-k-mers with a kept minimiser are packed and dealt to buckets. A bitmap of fixed
   size tells which are kept; a false hit, or a bitmap that is full, costs shuffle and never a result.
3. Each bucket sorts its windows and returns the places of those that a smaller document holds.
4. Documents are joined with their places, and covered words go.

Hot minimisers are those with over max(HOT_WINDOWS, total / HOT_MOST) windows, HOT_MOST at most. Their super-k-mers, which end after CUT windows,
are dealt over several buckets by document and place. Each bucket names the smallest document of every window that it holds, once; these meet
by window and the buckets that named a larger one than the smallest of all are told. So neither a hot minimiser nor a passage that most documents
share meets in one task, and a text that repeats a few words is
many super-k-mers instead of one. Equal windows still meet, as they meet by minimiser and code.

Defined cases: a null or empty text has no words and n_removed 0; a text shorter than the window keeps all
words; a row with a null doc_id is compared with nothing and keeps all; rows that repeat a doc_id all return, each judged by its own
text, as ids are compared strictly: rows of one id take nothing from each other.
Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm import textkit as tk
from lodeframe.llm.store import bounded_batches, checkpoint, parts

WINDOW, SEED = 50, 10
FILTER_BITS = 27
HOT_WINDOWS, HOT_MOST = 20_000, 4096
CUT = 2048
BUCKET_BYTES = 6e6
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Runs:
    """The super-k-mers of a slice: window codes, and for each run its minimiser, row, first window, length."""

    def __init__(self, part: tk.Slice, window: int, seed: int):
        words = part.words()
        self.at = words.windows(window)
        hashes = words.hashes()
        least = tk.sliding_min(tk.rolling(hashes, seed), window - seed + 1)[self.at]
        self.codes = tk.rolling(hashes, window)[self.at]
        row = words.row[self.at]
        new = np.ones(len(self.at), bool)
        new[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
        head = np.flatnonzero(new)
        new[np.arange(len(new)) - np.repeat(head, np.diff(np.append(head, len(new)))) & (CUT - 1) == 0] = True  # CUT is a power of two
        self.begin = np.flatnonzero(new)
        self.length = np.diff(np.append(self.begin, len(self.at)))
        self.minimiser = least[self.begin].view(np.int64)
        self.row = row[self.begin]
        self.place = (self.at - words.first[words.row[self.at]])[self.begin].astype(np.int32)


def _texts(documents: DataFrame) -> DataFrame:
    """doc_id, text and the text's digest, which tells rows of one id apart."""
    text = F.col("text").cast("string")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("digest"))


def _kept_texts(documents: DataFrame) -> DataFrame:
    return _texts(documents).filter("doc_id is not null and text is not null")


def _once(texts: DataFrame) -> DataFrame:
    """One row for each id and text. Only rows of ids that repeat are aggregated, and before the shuffle, as one may be most of the table."""
    twice = checkpoint(texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"))
    if twice.isEmpty():
        return texts
    one = texts.join(twice, "doc_id", "left_semi").groupBy("doc_id", "digest").agg(F.min("text").alias("text")).select("doc_id", "text", "digest")
    return texts.join(twice, "doc_id", "left_anti").select("doc_id", "text", "digest").union(one)


def _minimisers(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = tk.int64_column(batch, "doc_id")
            for part in tk.slices(tk.text_column(batch, "text")):
                runs = _Runs(part, window, seed)
                if len(runs.begin):
                    yield pa.record_batch([pa.array(runs.minimiser), pa.array(ids[part.first + runs.row]), pa.array(runs.length)], ["minimiser", "doc_id", "windows"])

    return run


def _pack(window: int, seed: int, bits, hot, buckets: int, is_hot: bool):
    """Super-k-mers with a kept minimiser, by bucket: those of hot minimisers, or all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(bits.value, np.uint64)
        shift = np.uint64(64 - FILTER_BITS)
        for batch in batches:
            ids, digests = tk.int64_column(batch, "doc_id"), tk.int64_column(batch, "digest")
            for part in tk.slices(tk.text_column(batch, "text")):
                runs = _Runs(part, window, seed)
                slot = runs.minimiser.view(np.uint64) >> shift
                split = _split(runs.minimiser, hot.value)
                hit = ((bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1) & ((split > 1) == is_hot)
                if not hit.any():
                    continue
                begin, length, key, row, place, split = (x[hit] for x in (runs.begin, runs.length, runs.minimiser, runs.row, runs.place, split))
                total = int(length.sum())
                inner = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
                at = part.first + row
                salt = tk.mix((ids[at] ^ digests[at] ^ place // CUT).view(np.uint64)) % split.astype(np.uint64)
                bucket = tk.mix(key.view(np.uint64) + salt * _STEP) % np.uint64(buckets)
                yield pa.record_batch(
                    [pa.array(bucket.astype(np.int32)), pa.array(key), pa.array(ids[at]), pa.array(digests[at]), pa.array(place), tk.packed(runs.codes[np.repeat(begin, length) + inner], length)],
                    ["bucket", "minimiser", "doc_id", "digest", "place", "codes"],
                )

    return run


def _split(keys: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Over how many buckets each minimiser is dealt."""
    known, parts_of = hot
    if not len(known):
        return np.ones(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, parts_of[at], 1)


def _windows(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Of each window of packed super-k-mers: code, minimiser, doc_id, place and the number of its row."""
    column = lambda name: table.column(name).chunk(0)
    codes, counts = tk.unpacked(column("codes"), np.uint64)
    of = np.repeat(np.arange(len(counts)), counts)
    spots = column("place").to_numpy()[of] + (np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts))
    return codes, column("minimiser").to_numpy()[of], column("doc_id").to_numpy()[of], spots, of


def _least(codes: np.ndarray, key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by window, where each window begins in it, and the smallest document of each place in it."""
    order = np.lexsort((doc, key, codes))
    new = np.ones(len(order), bool)
    for x in (codes, key):
        x = x[order]
        new[1:] &= x[1:] == x[:-1]
    new[1:] = ~new[1:]
    doc = doc[order]
    head = np.flatnonzero(new)
    return order, head, np.repeat(doc[head], np.diff(np.append(head, len(order))))


def _repeats(table: pa.Table, told: pa.Table | None = None) -> pa.Table:
    """The windows of a bucket that a smaller document holds: doc_id, digest and the packed places, by super-k-mer.

    told holds windows of which another bucket has a smaller document.
    """
    table = table.combine_chunks()
    if not len(table):
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.binary())], ["doc_id", "digest", "places"])
    codes, key, doc, spots, of = _windows(table)
    n = len(codes)
    if told is not None and len(told):
        told = told.combine_chunks()
        more, counts = tk.unpacked(told.column("codes").chunk(0), np.uint64)
        codes, key = np.concatenate([codes, more]), np.concatenate([key, np.repeat(told.column("minimiser").chunk(0).to_numpy(), counts)])
        doc = np.concatenate([doc, tk.unpacked(told.column("docs").chunk(0), np.int64)[0]])
    order, _, least = _least(codes, key, doc)
    found = np.zeros(len(order), bool)
    found[order] = doc[order] > least
    found = found[:n]
    spots, of = spots[found].astype(np.int32), of[found]
    runs, sizes = np.unique(of, return_counts=True)
    column = lambda name: pa.array(table.column(name).chunk(0).to_numpy()[runs])
    return pa.table([column("doc_id"), column("digest"), tk.packed(spots, sizes)], ["doc_id", "digest", "places"])


def _by(keys: list[np.ndarray], names: list[str], codes: np.ndarray, docs: np.ndarray) -> pa.Table:
    """Windows and their documents packed into a row for each combination of keys."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    head = np.flatnonzero(new)
    counts = np.diff(np.append(head, len(order)))
    return pa.table([*[pa.array(k[head]) for k in keys], tk.packed(codes[order], counts), tk.packed(docs[order], counts)], [*names, "codes", "docs"])


def _named(hot, buckets: int):
    """The smallest document of each window of a bucket, packed by the part where windows meet."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        codes, key, doc, _, _ = _windows(table)
        order, head, least = _least(codes, key, doc)
        codes, key, doc = codes[order][head], key[order][head], least[head]
        sub = tk.mix(codes ^ _STEP) % _split(key, hot.value).astype(np.uint64)
        part = (tk.mix(key.view(np.uint64) + sub * _STEP) % np.uint64(buckets)).astype(np.int32)
        bucket = np.full(len(codes), table.column("bucket").chunk(0).to_numpy()[0], np.int32)
        return _by([part, bucket, key], ["part", "bucket", "minimiser"], codes, doc)

    return run


def _told(table: pa.Table) -> pa.Table:
    """For each bucket the windows of which another one named a smaller document, and that document."""
    table = table.combine_chunks()
    codes, counts = tk.unpacked(table.column("codes").chunk(0), np.uint64)
    docs, _ = tk.unpacked(table.column("docs").chunk(0), np.int64)
    key, bucket = (np.repeat(table.column(x).chunk(0).to_numpy(), counts) for x in ("minimiser", "bucket"))
    order, _, least = _least(codes, key, docs)
    later = docs[order] > least
    order, least = order[later], least[later]
    return _by([bucket[order], key[order]], ["bucket", "minimiser"], codes[order], least)


def _remove(window: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, places = tk.text_column(batch, "text"), batch.column(batch.schema.get_field_index("places"))
            total, removed, digest, kept_text = [], [], [], []
            for text, found in zip(texts, places, strict=True):
                words = (text.as_py() or "").encode().split()
                kept = words
                if found.is_valid:
                    cover = np.zeros(len(words) + 1, np.int32)
                    for spots in found:
                        at = np.frombuffer(spots.as_buffer(), np.int32)
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + window, -1)
                    kept = list(compress(words, np.cumsum(cover[:-1]) == 0))
                joined = b" ".join(kept)
                total.append(len(words))
                removed.append(len(words) - len(kept))
                digest.append(hashlib.sha256(joined).hexdigest())
                if keep_text:
                    kept_text.append(joined.decode())
            columns = [batch.column(batch.schema.get_field_index("doc_id")), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
            yield pa.record_batch([*columns, *([pa.array(kept_text, pa.string())] if keep_text else [])], ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if keep_text else [])])

    return run


def repeated_places(documents: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """doc_id, digest of the text and places (a list of packed int32 word positions) of the windows that smaller documents hold."""
    spark = documents.sparkSession
    bounded_batches(spark)
    texts = _once(_kept_texts(documents))
    shared = checkpoint(
        texts.mapInArrow(_minimisers(window, seed), "minimiser long, doc_id long, windows long")
        .groupBy("minimiser")
        .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.sum("windows").alias("n"))
        .filter("least < most")
        .select("minimiser", "n")
    )
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit = max(HOT_WINDOWS, total // HOT_MOST)
    most = sorted((r.minimiser, max(2, -(-r.n // limit))) for r in shared.filter(F.col("n") > limit).collect())  # HOT_MOST rows at most
    slot = F.shiftrightunsigned("minimiser", 64 - FILTER_BITS)
    # one row for each 64 slots: 2**(FILTER_BITS - 6) rows at most, whatever the input
    words = shared.select(F.shiftright(slot, 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(minimiser, {64 - FILTER_BITS}) & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    buckets = parts(spark, total * 8, BUCKET_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    context = spark.sparkContext
    hot, kept = context.broadcast((np.array([k for k, _ in most], np.int64), np.array([n for _, n in most], np.int64))), context.broadcast(bitmap.tobytes())
    out = "doc_id long, digest long, places binary"
    packed = lambda is_hot: texts.mapInArrow(_pack(window, seed, kept, hot, buckets, is_hot), "bucket int, minimiser long, doc_id long, digest long, place int, codes binary")
    found = packed(False).groupBy("bucket").applyInArrow(lambda table: _repeats(table), out)
    if most:
        rows = checkpoint(packed(True))
        named = rows.groupBy("bucket").applyInArrow(_named(hot, buckets), "part int, bucket int, minimiser long, codes binary, docs binary")
        told = named.groupBy("part").applyInArrow(_told, "bucket int, minimiser long, codes binary, docs binary")
        found = found.union(rows.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(_repeats, out))
    return found.groupBy("doc_id", "digest").agg(F.collect_list("places").alias("places"))


def substring_dedup(documents: DataFrame, window: int = WINDOW, seed: int = SEED, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text, for each row of documents."""
    if not 0 < seed <= window:
        raise ValueError("seed must be from 1 to window")
    found = repeated_places(documents, window, seed)
    texts = _texts(documents)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    return texts.join(found, ["doc_id", "digest"], "left").mapInArrow(_remove(window, keep_text), schema)


#: The query's SQL.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
least AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h),
hit AS (SELECT doc_id, i FROM win JOIN least USING (h) WHERE first < doc_id),
cover AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM hit),
gone AS (SELECT doc_id, list(p) AS places FROM cover GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN places IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(places, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""
