"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the range is retained.

A shingle is `width` consecutive bytes of the UTF-8 text; a text shorter than the width is one shingle. The fraction is the same
for all texts, so sketches of unequal texts are comparable, merge by union, and their overlap estimates similarity and
containment. A non-empty text with no hash below the fraction keeps its least one instead, marked apart: it tells such
texts from each other, is never counted as a member, and a merge drops it for any retained hash. So the merge of two
sketches is the sketch of both sets of shingles. The empty text has the empty sketch. Equal texts have equal sketches.

`edited_fingerprints` also compares each document with an edited text: the last half of its code points
replaced by the first as many of the next document's, by doc_id, and the first document's after the last.
Documents are dealt to ranges of doc_id that follow the size of the table; each range gets the one next document that it needs besides,
and goes through it from the largest id down, so the next text is always the last one met. An id that fills several
ranges is dealt over as many. Each row moves once, and no task holds the rows of an id.

Defined cases: a null text is empty; rows that repeat a doc_id are each compared with the next larger id (of its texts,
that with the least hash); a row with a null doc_id has no next document: its edited text loses its last half and near_next is
null; two empty sketches have likeness 1, an empty and another 0; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm import textkit as tk
from lodeframe.llm.store import bounded_batches, parts

WIDTH, SHIFT = 16, 4  # the retained fraction is 2**-SHIFT
PART_BYTES, STEPS = 16e6, 512
BROADCAST_ENDS = 100_000  # rows of a range and an id
OUT_ROWS = 2000
_RETAINED = np.uint64(1 << 32)  # retained hashes are kept as the 32 bits below the threshold's; a least one, as it is, is larger


def sketches(column: pa.Array, width: int = WIDTH, shift: int = SHIFT) -> list[np.ndarray]:
    """The sorted retained hashes of each text, or its least one if that is not below the threshold."""
    found = []
    limit = np.uint64(1 << (64 - shift))
    drop = np.uint64(32 - shift)
    for part in tk.slices(column):
        symbols = tk._SYMBOL[part.data]
        hashes = tk.rolling(symbols, width)
        at = np.flatnonzero(hashes < limit)
        kept = hashes[at] >> drop
        bounds = part.bounds.tolist()
        low = np.searchsorted(at, part.bounds[:-1]).tolist()
        high = np.searchsorted(at, np.maximum(part.bounds[1:] - width + 1, part.bounds[:-1])).tolist()
        for begin, end, i, j in zip(bounds[:-1], bounds[1:], low, high, strict=True):
            if i < j:
                own = np.sort(kept[i:j])
                found.append(own[np.append(True, own[1:] != own[:-1])])
                continue
            if end - begin >= width:
                least = hashes[begin : end - width + 1].min(keepdims=True)
            else:
                least = tk.rolling(symbols[begin:end], end - begin) if end > begin else hashes[:0]
            found.append(np.where(least < limit, least >> drop, least))
    return found


def as_text(sketch: np.ndarray) -> str:
    """Eight hex digits for each retained hash; a least one has sixteen after a tilde."""
    if len(sketch) and sketch[0] >= _RETAINED:
        return f"~{int(sketch[0]):016x}"
    return sketch.astype(">u4").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    if fingerprint.startswith("~"):
        return np.array([int(fingerprint[1:], 16)], np.uint64)
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two documents' shingles."""
    both = np.union1d(a, b)
    retained = both[both < _RETAINED]
    return retained if len(retained) else both[:1]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if not len(a) or not len(b):
        return 0
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    return int((a[at] == b).sum())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of the two shingle sets."""
    common = _common(a, b)
    union = len(a) + len(b) - common
    return common / union if union else 1.0


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has too."""
    return _common(a, b) / len(a) if len(a) else 1.0


def fingerprints(documents: DataFrame, width: int = WIDTH, shift: int = SHIFT) -> DataFrame:
    """doc_id and fingerprint of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [as_text(x) for x in sketches(tk.text_column(batch, "text"), width, shift)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    bounded_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_containment double"


def _compared(width: int, shift: int):
    names = [x.split()[0] for x in OUT.split(", ")]

    def results(rows: list[tuple[int | None, str, str | None]]) -> pa.RecordBatch:
        """rows: id, text, next text; equal texts in a row are sketched once."""
        texts = [text for _, text, _ in rows]
        chars = [len(text) for text in texts]
        edited = [text[: n - n // 2] + (after or "")[: n // 2] for (_, text, after), n in zip(rows, chars, strict=True)]
        order: dict[str, int] = {}
        for _, text, after in rows:
            order.setdefault(text, len(order))
            if after is not None:
                order.setdefault(after, len(order))
        own = sketches(pa.array(list(order), pa.string()), width, shift)
        changed = sketches(pa.array(edited, pa.string()), width, shift)
        mine = [own[order[text]] for text in texts]
        return pa.record_batch(
            [
                pa.array([i for i, _, _ in rows], pa.int64()),
                pa.array(chars, pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
                pa.array(map(as_text, mine), pa.string()),
                pa.array(map(as_text, changed), pa.string()),
                pa.array([likeness(a, b) for a, b in zip(mine, changed, strict=True)]),
                pa.array([None if after is None else likeness(a, own[order[after]]) for a, (_, _, after) in zip(mine, rows, strict=True)], pa.float64()),
                pa.array([containment(a, b) for a, b in zip(mine, changed, strict=True)]),
            ],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by range, from the largest id down, the next document of the range first."""
        done: list[tuple[int | None, str, str | None]] = []
        size, where, own, first, after = 0, None, None, None, None
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()
            for part, tail, i, text in zip(get("part"), get("tail"), get("doc_id"), tk.text_column(batch, "text"), strict=True):
                text = text.as_py() or ""
                if part != where:
                    where, own, first, after = part, None, None, None
                if i is None:
                    done.append((None, text, None))
                elif tail:
                    first = text
                else:
                    if i != own:
                        own, first, after = i, text, first
                    done.append((i, text, after))
                size += len(text)
                if len(done) >= OUT_ROWS or size >= 2 * tk.SLICE_BYTES and done:
                    yield results(done)
                    done, size = [], 0
        if done:
            yield results(done)

    return run


def _located(bounds: np.ndarray):
    """part, the number of bounds that aren't above doc_id, and doc_id of each row that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).drop_null().to_numpy()
            yield pa.record_batch([pa.array(np.searchsorted(bounds, ids, "right").astype(np.int32)), pa.array(ids)], ["part", "doc_id"])

    return run


def _splits(ids: DataFrame, count: int) -> np.ndarray:
    """About count - 1 ids at equal distances in the order of rows; an id that holds several ranges comes as often.

    Beyond STEPS ranges each of them is split again, so no summary of quantiles has to be finer than STEPS.
    """
    steps = lambda n: [k / n for k in range(1, n)]
    quantiles = lambda n: F.percentile_approx("doc_id", steps(n), 20 * STEPS)
    coarse = np.array(ids.agg(quantiles(min(count, STEPS))).first()[0] or [] if count > 1 else [], np.int64)
    if count <= STEPS or not len(coarse):
        return coarse
    rows = ids.mapInArrow(_located(np.unique(coarse)), "part int, doc_id long").groupBy("part").agg(quantiles(min(STEPS, -(-count // STEPS))).alias("at")).collect()  # a row for each of STEPS ranges
    return np.sort(np.concatenate([coarse, *(np.array(r["at"] or [], np.int64) for r in rows)]))


def _dealt(bounds: np.ndarray, hot: dict[int, tuple[int, int]]):
    """Each row with its range; the rows of an id in hot (first range, number) go round its own ranges, and so do those without an id."""
    keys = np.array(sorted(hot), np.int64)
    first, number = (np.array([hot[k][j] for k in keys.tolist()], np.int64) for j in (0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 7919 * TaskContext.get().partitionId() if TaskContext.get() else 0
        for batch in batches:
            ids = batch.column(0)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            values = ids.fill_null(0).to_numpy()
            turn = seen + np.arange(len(values))
            seen += len(values)
            part = np.where(known, np.searchsorted(bounds, values, "right"), turn % (len(bounds) + 1))
            if len(keys):
                at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
                part = np.where(known & (keys[at] == values), first[at] + turn % number[at], part)
            yield pa.record_batch([pa.array(part.astype(np.int32)), pa.array(np.zeros(len(values), bool)), *batch.columns], ["part", "tail", "doc_id", "text", "rank"])

    return run


def edited_fingerprints(documents: DataFrame, width: int = WIDTH, shift: int = SHIFT) -> DataFrame:
    """The columns of OUT for each row of documents."""
    spark = documents.sparkSession
    bounded_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("rank"))
    size, least = texts.agg(F.sum(F.octet_length("text")), F.min("doc_id")).first()
    count = parts(spark, size or 0, PART_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    splits, times = np.unique(_splits(texts.select("doc_id"), count), return_counts=True)
    starts = len(splits) + 1 + np.cumsum(times) - times
    hot = {int(i): (int(at), int(n)) for i, n, at in zip(splits, times, starts, strict=True) if n > 1}

    # the document after a range: its upper bound, which is an id of the table, and the least of all after the last
    after = [*splits.tolist(), least]
    tails = list(enumerate(after)) if least is not None else []
    if hot:
        apart = texts.select("doc_id").join(F.broadcast(spark.createDataFrame([(i,) for i in hot], "doc_id long")), "doc_id", "left_anti")
        low = {r.part: r.doc_id for r in apart.mapInArrow(_located(splits), "part int, doc_id long").groupBy("part").agg(F.min("doc_id").alias("doc_id")).collect()}  # a row for each range
        for k, i in enumerate(splits.tolist(), 1):
            if i in hot:
                tails += [(hot[i][0] + j, low.get(k, after[k])) for j in range(hot[i][1])]
    ends = spark.createDataFrame(tails, "part int, doc_id long")
    near = F.broadcast if len(tails) <= BROADCAST_ENDS else (lambda x: x)
    wanted = texts.join(near(ends.select("doc_id").distinct()), "doc_id", "left_semi")
    one = wanted.groupBy("doc_id").agg(F.min(F.struct("rank", "text")).alias("of")).select("doc_id", "of.text", "of.rank")
    last = one.join(near(ends), "doc_id").select("part", F.lit(True).alias("tail"), "doc_id", "text", "rank")
    moved = texts.mapInArrow(_dealt(splits, hot), "part int, tail boolean, doc_id long, text string, rank long").union(last)
    return moved.repartition(count, "part").sortWithinPartitions("part", F.desc("tail"), F.desc("doc_id"), "rank").mapInArrow(_compared(width, shift), OUT)
