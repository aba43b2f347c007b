"""Mixing sources to target weights by capped water-filling, with DataFrame operations only.

Each source has a weight and a size, the number of its words. Targets share the total by weight; no target exceeds
EPOCHS times its source's size, and what a cap cuts off is shared again by weight until none is above. With sources sorted by
cap over weight, the water level is that of the first source that it doesn't drown, so one window over the source table
(a row for each source) finds the fixed point.

A source with a target of e epochs is taken floor(e) times as a whole; the fraction is a seeded sample: documents in the order
of a hash of id and text, each of which is taken if it fits the words that are left, and then the one further document that comes nearest
to the rest, if that is nearer than none. Order is kept by hash prefix: sizes are summed by (source, prefix) before any shuffle, running
sums go over the prefixes, and only the documents of the prefix in which a sample ends are sorted. Rows that share a hash are summed by
partition first. So no source and no group of copies, however large, meets in one task.

Defined cases: a null or empty text has size 0 and is taken 0 words; a null source is a source of its own, last in order;
sources without words have target 0; a null doc_id hashes as an empty one; rows that repeat, and rows of one id, are sampled each (rows equal in
id and text are interchangeable, and any of them may be the ones taken); no row is copied more than `epochs` times, wordless ones included; an empty table
gives no row; other columns are carried along by `mix_documents` and ignored otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodeframe.llm.store import checkpoint

WORD = r"[^\x20\x09-\x0D]+"
EPOCHS, SEED = 3, "mix-1"
BROADCAST_SOURCES, WINDOW_ROWS = 10_000, 16_384


def _rank(doc_id: Column, text: Column) -> Column:
    """60 bits of a seeded hash of id and text, as a number, so that sums and minima over it aggregate by hash."""
    whole = F.concat(F.lit(SEED + ":"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Column | None = None, epochs: int = EPOCHS) -> DataFrame:
    """source_key, source_size and target of each source of sizes (source_key, source, size).

    weights may refer to place, the source's number from 1 in the order of code points, null last.
    """
    weights = F.pmod(F.col("place") - 1, F.lit(3)) + 1 if weights is None else weights
    every = W.orderBy(F.col("source").asc_nulls_last())  # rows of sources, not of documents
    sources = sizes.groupBy("source_key", "source").agg(F.sum("size").alias("source_size")).withColumn("place", F.row_number().over(every)).withColumn("weight", weights.cast("double"))
    level = W.orderBy(F.col("ratio"), F.col("place"))
    before = level.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(F.lit(1))
    filled = (
        sources.withColumn("cap", (epochs * F.col("source_size")).cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("water", F.col("left") / F.col("open"))
        .withColumn("level", F.min(F.when(F.col("water") <= F.col("ratio"), F.struct("ratio", "place", "water"))).over(whole)["water"])
    )
    return filled.select("source_key", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def _most(rows: DataFrame) -> int:
    """The number of rows of the source that has most of them."""
    return rows.groupBy("source_key").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def _by_source(df: DataFrame, hint) -> DataFrame:
    """df, a row for each source, computed once: as one file where sources are few enough to be broadcast."""
    return checkpoint(df.repartition(1) if hint is F.broadcast else df)


def _stops(rows: DataFrame, most: int, hint) -> DataFrame:
    """source_key, stop_rank and stop_row of the first row that overshoots the gap (null: none does), and the words reached before it.

    rows have source_key, gap, size, rank and row, most of one source. While a source has more than WINDOW_ROWS rows, sums go over a prefix of the
    rank, then over more of it, and over partitions if so many rows share one rank; only the rest is sorted, so neither a large source nor
    many equal rows meet in one task.
    """
    left = rows.select("source_key", "gap", F.lit(0).cast("long").alias("before"), "size", "rank", "row")
    every = []
    for digit in (F.shiftright("rank", 48), F.shiftright("rank", 32), F.col("rank"), F.shiftright("row", 33)):
        if most <= WINDOW_ROWS:
            break
        running = W.partitionBy("source_key").orderBy("digit").rowsBetween(W.unboundedPreceding, W.currentRow)
        sums = left.groupBy("source_key", "gap", "before", digit.alias("digit")).agg(F.sum("size").alias("words")).withColumn("until", F.col("before") + F.sum("words").over(running))
        over = F.col("until") > F.col("gap")
        # the first digit at which a sum is over the gap, and the words before it
        ends = _by_source(sums.groupBy("source_key").agg(F.min(F.when(over, F.col("digit"))).alias("end"), F.min(F.when(over, F.col("until") - F.col("words"))).alias("next"), F.max("until").alias("all")), hint)
        every.append(ends.filter("end is null").select("source_key", F.lit(None).cast("long").alias("stop_rank"), F.lit(None).cast("long").alias("stop_row"), F.col("all").alias("reached")))
        left = checkpoint(left.join(hint(ends.select("source_key", "end", "next")), "source_key").filter(digit == F.col("end")).select("source_key", "gap", F.col("next").alias("before"), "size", "rank", "row"))
        most = _most(left)
    order = W.partitionBy("source_key").orderBy("rank", "row").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = left.withColumn("until", F.col("before") + F.sum("size").over(order))
    over = F.col("until") > F.col("gap")
    found = sums.groupBy("source_key").agg(F.min(F.when(over, F.struct("rank", "row"))).alias("stop"), F.coalesce(F.max(F.when(~over, F.col("until"))), F.min("before")).alias("reached"))
    every.append(found.select("source_key", F.col("stop.rank").alias("stop_rank"), F.col("stop.row").alias("stop_row"), "reached"))
    return reduce(lambda a, b: a.union(b), every)


def _is_before(rank: Column, row: Column) -> Column:
    """Whether a row comes before a stop; all do before none."""
    return rank.isNull() | (F.col("rank") < rank) | (F.col("rank") == rank) & (F.col("row") < row)


def _steps(narrow: DataFrame, gaps: DataFrame, hint) -> DataFrame:
    """source_key, gap (words still missing) and steps: a row up to a step's gap in size and before its stop is in.

    A step takes rows in order up to the first that overshoots; the next one goes on behind it with the rows that still fit. So each row in turn
    is taken if it fits, and the steps come to an end, as what stops a step is longer than the next one's gap.
    """
    none = F.expr("cast(array() as array<struct<gap:bigint,stop_rank:bigint,stop_row:bigint>>)")
    plan = gaps.select("source_key", "gap", none.alias("steps"), F.lit(-1).cast("long").alias("stop_rank"), F.lit(-1).cast("long").alias("stop_row"))
    left, first = narrow, True
    while True:
        behind = (F.col("rank") > F.col("stop_rank")) | (F.col("rank") == F.col("stop_rank")) & (F.col("row") > F.col("stop_row"))
        fits = F.lit(True) if first else (F.col("size") > 0) & (F.col("size") <= F.col("gap")) & behind
        open_ = plan.select("source_key", "gap", "stop_rank", "stop_row")
        left = left.select("source_key", "size", "rank", "row").join(hint(open_), "source_key").filter(fits).select("source_key", "gap", "size", "rank", "row")
        left = left if first else checkpoint(left)
        most = _most(left)
        if not most:
            return plan.select("source_key", "steps", "gap")
        now = _stops(left, most, hint).withColumnRenamed("stop_rank", "at_rank").withColumnRenamed("stop_row", "at_row")
        step = F.struct("gap", F.col("at_rank").alias("stop_rank"), F.col("at_row").alias("stop_row"))
        went = F.col("reached").isNotNull()
        # a source of which nothing fits any more, or all does, is done: its stop is null
        plan = _by_source(
            plan.join(hint(now), "source_key", "left").select(
                "source_key",
                (F.col("gap") - F.coalesce("reached", F.lit(0))).alias("gap"),
                F.when(went, F.array_append("steps", step)).otherwise(F.col("steps")).alias("steps"),
                F.col("at_rank").alias("stop_rank"),
                F.col("at_row").alias("stop_row"),
            ),
            hint,
        )
        first = False


def _taken(documents: DataFrame, columns: list[str], weights: Column | None, epochs: int) -> DataFrame:
    """columns of documents with size, source_size, target, copies and taken."""
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    facts = {"size": size, "source_key": F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source)), "rank": _rank(F.col("doc_id"), text), "row": F.monotonically_increasing_id()}
    carried = [c for c in columns if c != "doc_id"]
    # row tells equal rows apart, so all that reads it reads the file in which it is kept; the steps read one without texts
    rows = checkpoint(documents.withColumns(facts).select("doc_id", source.alias("source"), *facts, *carried))
    narrow = checkpoint(rows.select("doc_id", "source", *facts)) if carried else rows
    targets = checkpoint(source_targets(narrow, weights, epochs))
    small = targets.count() <= BROADCAST_SOURCES
    hint = F.broadcast if small else (lambda x: x)

    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    fraction = targets.withColumn("epochs", F.least(whole, F.lit(epochs).cast("long"))).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size")))
    plan = _steps(narrow, fraction.select("source_key", F.floor("rest").cast("long").alias("gap")), hint)
    # rows of the first step are in, wordless ones too, then those that fit behind it; the nearest of the others closes the gap
    first, fits = F.get("steps", F.lit(0)), F.exists("steps", lambda s: (F.col("size") <= s["gap"]) & _is_before(s["stop_rank"], s["stop_row"]))
    is_in = _is_before(first["stop_rank"], first["stop_row"]) | (F.col("size") > 0) & fits
    others = narrow.join(hint(plan), "source_key").withColumn("off", F.abs(F.col("gap") - F.col("size"))).filter(~is_in & (F.col("off") < F.col("gap"))).select("source_key", "off", "rank", "row")
    least = _by_source(others.groupBy("source_key").agg(F.min("off").alias("off")), hint)
    nearest = others.join(hint(least), ["source_key", "off"]).groupBy("source_key").agg(F.min(F.struct("rank", "row")).alias("extra"))
    plan = _by_source(fraction.join(hint(plan), "source_key").join(hint(nearest), "source_key", "left").select("source_key", "source_size", "target", "epochs", "steps", "extra"), hint)
    taken_too = is_in | F.coalesce((F.col("rank") == F.col("extra")["rank"]) & (F.col("row") == F.col("extra")["row"]), F.lit(False))
    joined = rows.join(hint(plan), "source_key").withColumn("copies", F.least(F.lit(epochs).cast("long"), F.col("epochs") + F.when(taken_too, 1).otherwise(0)))
    return joined.select(*columns, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(documents: DataFrame, weights: Column | None = None, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken of each row of documents (doc_id, source, text)."""
    return _taken(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text"), ["doc_id"], weights, epochs)


def mix_documents(documents: DataFrame, weights: Column | None = None, epochs: int = EPOCHS) -> DataFrame:
    """The columns of documents, each row as often as the mix takes it."""
    columns = documents.columns
    own = documents.toDF(*[f"own_{c}" for c in columns])
    at = {c.lower(): f"own_{c}" for c in columns}
    named = own.select("*", F.col(at["doc_id"]).cast("long").alias("doc_id"), F.col(at["source"]).alias("source"), F.col(at["text"]).alias("text"))
    kept = _taken(named, [f"own_{c}" for c in columns] + ["doc_id"], weights, epochs)
    again = kept.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return again.select(*[F.col(f"own_{c}").alias(c) for c in columns])


#: The query's SQL: the same water level and the same seeded sample; g takes each further document that fits, one by one.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, ''))[1:15] AS rank FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source
), c AS (
  SELECT *, ((place - 1) % 3 + 1)::DOUBLE AS weight, (3 * source_size)::DOUBLE AS cap FROM s
), r AS (
  SELECT *, cap / weight AS ratio FROM c
), f AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER w, 0) AS rest_words,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS rest_weight
  FROM r WINDOW w AS (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT arg_min(rest_words / rest_weight, ratio * 1000003 + place) AS water FROM f WHERE rest_words / rest_weight <= ratio
), t AS (
  SELECT source, source_size, least(cap, water * weight) AS target,
         CASE WHEN source_size > 0 THEN floor(least(cap, water * weight) / source_size) ELSE 0 END::BIGINT AS epochs FROM f, l
), q AS MATERIALIZED (
  SELECT d.*, t.source_size, t.target, t.epochs, floor(greatest(0.0, t.target - t.epochs * t.source_size))::BIGINT AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY rank, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS until
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), g(source, gap, past) AS (
  SELECT source, any_value(rest) - coalesce(max(until) FILTER (until <= rest), 0), min(rank) FILTER (until > rest) FROM q GROUP BY source
  UNION ALL
  SELECT g.source, any_value(g.gap) - arg_min(q.size, q.rank), min(q.rank)
  FROM g JOIN q ON g.source IS NOT DISTINCT FROM q.source AND q.rank > g.past AND q.size > 0 AND q.size <= g.gap GROUP BY g.source
), e AS (
  SELECT source, min(gap) AS gap FROM g GROUP BY source
), o AS (
  SELECT q.*, q.until <= q.rest OR (q.size > 0 AND EXISTS (FROM g WHERE g.source IS NOT DISTINCT FROM q.source AND g.past = q.rank AND q.until > q.rest
    AND g.past > (SELECT min(z.past) FROM g z WHERE z.source IS NOT DISTINCT FROM q.source))) AS inside FROM q
), x AS (
  SELECT o.source, arg_min(o.doc_id, (abs(e.gap - o.size), o.rank)) AS extra
  FROM o JOIN e ON o.source IS NOT DISTINCT FROM e.source
  WHERE NOT inside AND abs(e.gap - o.size) < e.gap GROUP BY o.source
), n AS (
  SELECT o.*, least(3, o.epochs + (inside OR coalesce(o.doc_id = x.extra, false))::BIGINT)::BIGINT AS copies
  FROM o LEFT JOIN x ON o.source IS NOT DISTINCT FROM x.source
)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM n
"""
