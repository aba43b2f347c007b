"""Baselines that the contract describes in prose: calibrated bands and text-blind tabular models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOW, HIGH = 0.05, 0.95


def residual_bands(df: DataFrame, keys: list[str], point: str, truth: str) -> DataFrame:
    """The residuals' quantiles of each key, as offsets of a calibrated interval."""
    off = F.col(truth) - F.col(point)
    return df.groupBy(*keys).agg(F.percentile(off, LOW).alias("low_offset"), F.percentile(off, HIGH).alias("high_offset"), F.count(F.lit(1)).alias("n"))


def calibrated(df: DataFrame, bands: DataFrame, keys: list[str], point: str) -> DataFrame:
    """df with low and high from the bands of its keys."""
    return df.join(bands, keys).withColumn("low", F.col(point) + F.col("low_offset")).withColumn("high", F.col(point) + F.col("high_offset"))


def boosted(train: DataFrame, features: list[str], label: str, classify: bool, rounds: int = 20):
    """A gradient-boosted tree pipeline on numeric features, text unseen."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    model = (GBTClassifier if classify else GBTRegressor)(labelCol=label, featuresCol="features", maxIter=rounds, seed=7)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), model]).fit(train)
