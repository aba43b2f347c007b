"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.store import checkpoint, spread_join


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for each node of links (a, b), by alternating stars.

    Each round hangs neighbours on smaller minima, so stars form in a number of rounds that follows the
    logarithm of the longest chain. Aggregates combine before the shuffle; a hub's rows are dealt over several tasks.
    No link gives no row; loops and repeated links are harmless.
    """
    edges = checkpoint(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = checkpoint(spread_join(both.filter("b > a"), least, ["a"], F.xxhash64("b")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = spread_join(large, low, ["a"], F.xxhash64("b")).select("b", "m").filter("b > m").union(low.select("a", "m")).toDF("a", "b")
        edges = checkpoint(small.distinct())
    return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").union(edges.select("b", "b").distinct())
