"""The same tests on streams: citations against a cutoff, the claims cap, and interval losses by event time.

Each function takes and gives a DataFrame and works on a static one as well, so the batch tests hold for both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.functions import metrics
from lodeframe.operators import citations


def stamped(claims: DataFrame, docs: DataFrame, on: list[str]) -> DataFrame:
    """A stream of claims joined to the static documents, with the embargo state of each."""
    joined = citations.resolve(claims, docs, on, ["doc_date"])
    return joined.withColumn("embargo", citations.embargo_state(F.col("doc_id"), F.col("resolved"), F.col("doc_date"), F.col("cutoff")))


def embargo_counts(stamped_claims: DataFrame, time: str, late: str, window: str) -> DataFrame:
    """Counts of each state by tumbling window; rows later than `late` are dropped by the watermark."""
    return stamped_claims.withWatermark(time, late).groupBy(F.window(time, window), "embargo").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "embargo", "n")


def loss_by_window(rows: DataFrame, time: str, late: str, window: str, level: float) -> DataFrame:
    """Mean interval loss by tumbling window of event time, from columns low, high and y."""
    loss: Column = metrics.interval_loss(F.col("low"), F.col("high"), F.col("y"), level)
    return rows.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.avg(loss).alias("loss"), F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "loss", "n")
