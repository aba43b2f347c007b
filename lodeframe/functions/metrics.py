"""Scores as column and aggregate expressions. Every ratio is guarded: a zero denominator never raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# fixed values of the scoring contract
WEIGHTS, LEVEL, CONSTANT_RULE, WORST, PADDING = (0.7, 0.3), 0.90, 0.5, 0.0, 3


def rounded(x: Column, digits: int = 0) -> Column:
    """A double to so many decimals, or to a power of ten if negative: scaled, rounded half away from zero and scaled back, as SQL's round() does on doubles.

    F.round takes the shortest decimal of the double instead, so it differs where the scaled double lies on the other side of a half.
    """
    scale = F.lit(10.0 ** abs(digits))
    scaled = F.abs(x * scale if digits >= 0 else x / scale)
    whole = F.floor(scaled)
    away = F.when(scaled < 2.0**52, (whole + (scaled - whole >= 0.5).cast("int")).cast("double")).otherwise(scaled) * F.signum(x)
    return F.when(scaled < float("inf"), away / scale if digits >= 0 else away * scale).otherwise(x)


def accuracy(predicted: Column, truth: Column) -> Column:
    """Share of rows whose label is the truth; a missing label is wrong."""
    return F.avg(F.coalesce((predicted == truth).cast("double"), F.lit(0.0)))


def error_ratio(error: Column, naive_error: Column) -> Column:
    """MAE_naive / (MAE_naive + MAE) of two aggregates; 1 for an exact answer, also against an exact rule."""
    return F.when(error == 0, 1.0).otherwise(F.coalesce(F.try_divide(naive_error, naive_error + error), F.lit(0.0)))


def interval_loss(low: Column, high: Column, truth: Column, level: Column | float = LEVEL) -> Column:
    """Width plus 2/alpha times the distance by which the truth lies outside; alpha is 1 - level."""
    level = F.lit(level) if isinstance(level, float) else level
    outside = F.greatest(low - truth, F.lit(0.0)) + F.greatest(truth - high, F.lit(0.0))
    return high - low + 2 / (1 - level) * outside


def ratio_quality(loss: Column, naive_loss: Column) -> Column:
    """naive / (naive + own)."""
    return F.try_divide(naive_loss, naive_loss + loss)


def capped(interval_quality: Column, quality: Column) -> Column:
    """An interval earns no more than the point forecast, or a half."""
    return F.least(interval_quality, F.greatest(F.lit(0.5), quality))


def anchored(quality: Column, anchor: Column) -> Column:
    """Piecewise linear through (0, 0), (anchor, 1/2) and (1, 1); an anchor of 1 is met by a perfect answer only."""
    above = 0.5 + F.try_divide(quality - anchor, 2 * (1 - anchor))
    below = F.try_divide(quality, 2 * anchor)
    return F.when(quality >= anchor, F.when(anchor > 1 - 1e-12, 1.0).otherwise(above)).otherwise(F.coalesce(below, F.lit(0.5)))


def anchor_of(naive_quality: Column, target_type: Column) -> Column:
    """A ranking is also held against the constant rule."""
    return F.when(target_type == "ranking", F.greatest(naive_quality, F.lit(CONSTANT_RULE))).otherwise(naive_quality)


def covered(low: Column, high: Column, truth: Column) -> Column:
    return F.avg(F.coalesce(((low <= truth) & (truth <= high)).cast("double"), F.lit(0.0)))


def composite(quality: Column, interval_quality: Column, w_a: Column | float = WEIGHTS[0], w_c: Column | float = WEIGHTS[1]) -> Column:
    """Weighted sum, or the quality alone where no interval is scored."""
    return F.when(interval_quality.isNull(), quality).otherwise(w_a * quality + w_c * interval_quality)


def soft_floor(false: Column, total: Column, entities: Column, k: float = 1.0) -> Column:
    """(1 - F / (F + min(T, 3E)))**k, with F false and T true claims of E entities; 1 where nothing is false.

    True claims beyond 3 for each entity don't dilute false ones.
    """
    honest = F.least(total - false, PADDING * entities)
    return F.when(false <= 0, 1.0).otherwise(F.pow(1 - F.coalesce(F.try_divide(false, false + honest), F.lit(1.0)), F.lit(k)))


def faithful_share(false: Column, total: Column) -> Column:
    return F.coalesce(1 - F.try_divide(false, total), F.lit(1.0))


def clipped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def with_worst_case(score: Column, failed: Column) -> Column:
    """A failed submission keeps its place in the denominator with the worst score."""
    return F.when(failed, F.lit(WORST)).otherwise(clipped(score))


def leaderboard(analysis: Column, reasoning: Column) -> Column:
    """The published display transform."""
    return -0.27 + 1.27 * analysis + 0.25 * F.coalesce(reasoning, F.lit(0.0))


def average_rank(value: Column, keys: list[str]) -> Column:
    """Ranks from 1; ties share the mean of their places."""
    own = W.partitionBy(*keys)
    return F.rank().over(own.orderBy(value)) + (F.count(F.lit(1)).over(W.partitionBy(*keys, value)) - 1) / 2.0


def rank_quality(df: DataFrame, keys: list[str], predicted: str, truth: str) -> DataFrame:
    """(rho + 1) / 2 of Spearman's rank correlation for each key; 1/2 for constants and single rows."""
    ranked = df.select(*keys, average_rank(F.col(predicted), keys).alias("_x"), average_rank(F.col(truth), keys).alias("_y"))
    spread = F.stddev_pop("_x") * F.stddev_pop("_y")
    rho = F.when(spread > 0, F.try_divide(F.covar_pop("_x", "_y"), spread)).otherwise(0.0)
    return ranked.groupBy(*keys).agg(((rho + 1) / 2).alias("rank_quality"))
