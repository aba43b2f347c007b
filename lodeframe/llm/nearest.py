"""Exact nearest neighbours by a block matrix join of int8 products with error bounds.

Queries and candidates are dealt to blocks of bounded size; each pair of blocks meets in one task. There unit vectors
are int8 codes with a scale each, and one product of the code matrices (exact, as its sums stay below 2**24 in float32)
gives every cosine up to a bound that follows from the two rounding errors. Candidates whose upper bound reaches the
k-th largest lower bound of their query survive; only those are computed in double precision from the original vectors.
Heaps keep the k best of each query, per block and then over blocks. No candidate is lost, so recall is 1.

Cosines are dot(a, b) / (sqrt(dot(a, a)) * sqrt(dot(b, b))) with sums in the order of components, so equal vectors have equal scores.

Defined cases: null, empty or zero vectors, and those with null or non-finite components, take no part, nor does a row with a
null vec_id; vectors of another dimension than the query's are no candidates of it; rows that repeat a vec_id are one
vector, the least of them in the order of components; ties go to the smaller vec_id; fewer than k candidates give fewer rows;
other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.store import checkpoint, parts

QUERY_BLOCK, CANDIDATE_BLOCK, CHUNK = 2048, 8192, 128


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of matching rows, summed component by component."""
    dot, own, other = (np.cumsum(x * y, axis=1)[:, -1] for x, y in ((a, b), (a, a), (b, b)))
    return dot / (np.sqrt(own) * np.sqrt(other))


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes (as float32) of the rows' directions, their scales, and the norms of what rounding lost."""
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    unit = unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127
    code = np.rint(unit / scale[:, None])
    lost = np.sqrt(((unit - code * scale[:, None]) ** 2).sum(axis=1)) + 1e-9
    return code.astype(np.float32 if x.shape[1] <= 1040 else np.float64), scale, lost


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids, in order, and their vectors; all rows have one length and finite components."""
    table = table.combine_chunks()
    ids = table.column("vec_id").to_numpy()
    order = np.argsort(ids)
    return ids[order], table.column("embedding").chunk(0).flatten().to_numpy().astype(np.float64).reshape(len(table), -1)[order]


def _tile(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not len(queries) or not len(candidates):
            return schema.empty_table()
        q_ids, q = _matrix(queries)
        c_ids, c = _matrix(candidates)
        q_code, q_scale, q_lost = codes(q)
        c_code, c_scale, c_lost = codes(c)
        found: list[tuple[int, int, float]] = []
        for at in range(0, len(q_ids), CHUNK):
            part = slice(at, at + CHUNK)
            near = (q_code[part] @ c_code.T).astype(np.float64) * q_scale[part, None] * c_scale
            error = q_lost[part, None] + (1 + q_lost[part, None]) * c_lost
            low, high = near - error, near + error
            own = q_ids[part, None] == c_ids
            low[own] = high[own] = -np.inf
            count = min(k, len(c_ids))
            bound = np.partition(low, len(c_ids) - count, axis=1)[:, len(c_ids) - count]
            row, column = np.nonzero((high >= bound[:, None]) & ~own)
            for begin in range(0, len(row), 65_536):
                r, j = row[begin : begin + 65_536], column[begin : begin + 65_536]
                score = cosine(q[part][r], c[j])
                for i in np.unique(r).tolist():
                    best = heapq.nsmallest(k, zip((-score[r == i]).tolist(), c_ids[j[r == i]].tolist(), strict=True))
                    found += [(int(q_ids[at + i]), v, -s) for s, v in best]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), schema.types, strict=True)], schema=schema) if found else schema.empty_table()

    return run


def _merge(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by query; a heap holds the k best of one query, each id once."""
        query, heap, held = None, [], set()
        out: list[tuple[int, int, int, float]] = []

        def close() -> None:
            for rank, (s, v) in enumerate(sorted(heap, reverse=True), 1):
                out.append((query, rank, -v, s))

        def batch() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else ((), (), (), ())
            return pa.record_batch([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)], ["query_id", "rank", "vec_id", "score"])

        for table in batches:
            for q, v, s in zip(*(table.column(n).to_pylist() for n in range(3)), strict=True):
                if q != query:
                    close()
                    query, heap, held = q, [], set()
                if v in held:
                    continue
                if len(heap) < k:
                    heapq.heappush(heap, (s, -v))
                    held.add(v)
                elif (s, -v) > heap[0]:
                    held.discard(-heapq.heapreplace(heap, (s, -v))[1])
                    held.add(v)
            if len(out) >= 4096:
                yield batch()
                out.clear()
        close()
        yield batch()

    return run


def _once(vectors: DataFrame) -> DataFrame:
    """One row for each vec_id. Only ids that repeat are aggregated with their vectors, and before the shuffle, as one may hold most rows."""
    twice = checkpoint(vectors.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("vec_id"))
    if twice.isEmpty():
        return vectors
    one = vectors.join(twice, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))
    return vectors.join(twice, "vec_id", "left_anti").unionByName(one)


def nearest(embeddings: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest rows of each row for which is_query holds."""
    spark = embeddings.sparkSession
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    vectors = vectors.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0)).withColumn("dim", F.size("embedding"))
    vectors = _once(vectors)
    queries = vectors.filter(is_query)
    n, q = vectors.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    tiles = parts(spark, n, CANDIDATE_BLOCK, min(int(spark.conf.get("spark.sql.shuffle.partitions")), parts(spark, n, 512)))
    blocks = parts(spark, q, QUERY_BLOCK)
    queries = queries.select(*[F.col(c).alias(c) for c in queries.columns])  # columns of its own, as the join is one of a table with itself
    left = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    right = vectors.withColumn("tile", F.pmod(F.xxhash64(F.lit(7), "vec_id"), F.lit(tiles)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    keys = ["dim", "tile", "block"]
    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_tile(k), "query_id long, vec_id long, score double")
    return pairs.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")


#: The query's SQL, in the same arithmetic.
ORACLE = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v), p AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.e, b.e) / (a.norm * b.norm) AS score
  FROM n a JOIN n b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p
) WHERE rank <= 5
"""
