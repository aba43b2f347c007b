"""Cutting lineage in the shared folder, and counts that size the next step."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.session import bounded_batches  # noqa: F401  for the operators


def checkpoint(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder of spark.checkpoint.dir.

    The folder is the cluster's. Only a local session that has none, as in tests, gets one here; elsewhere that is an error.
    Spark removes what no plan needs any more if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "lodeframe-checkpoints"))
    return df.checkpoint(eager=True)


def parts(spark: SparkSession, size: float, each: float, least: int = 1) -> int:
    """How many parts hold size in portions of about each."""
    return max(least, int(-(-size // each)))


HOT_ROWS, HOT_KEYS = 1000, 4096


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, how: str = "inner", narrow: DataFrame | None = None) -> DataFrame:
    """left joined with right, which holds each key once; a key of very many left rows is dealt over several tasks by the hash spread.

    Hot keys, HOT_KEYS at most, are those with over max(HOT_ROWS, rows / HOT_KEYS) rows. Their right rows are copied to each part.
    They are counted in narrow, which has left's rows at less cost, if it is given.
    """
    narrow = left if narrow is None else narrow
    limit = max(HOT_ROWS, narrow.count() // HOT_KEYS)
    found = narrow.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > limit).select(*keys, F.ceil(F.col("_rows") / limit).cast("int").alias("_parts"))
    rows = found.collect()  # HOT_KEYS at most, by the limit
    if not rows:
        return left.join(right, keys, how)
    hot = F.broadcast(left.sparkSession.createDataFrame(rows, found.schema))
    part = F.pmod(spread, F.coalesce("_parts", F.lit(1))).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    dealt = left.join(hot, keys, "left").withColumn("_part", part).drop("_parts")
    copied = right.join(hot, keys, "left").withColumn("_part", every).drop("_parts")
    return dealt.join(copied, [*keys, "_part"], how).drop("_part")
