"""The reasoning grader's panel: votes of several judges on each cell become components, target reasons and a bonus.

A cell is one component of one target reason of an answer, put to VOTES votes that hold it for met (1), not met (0) or abstain (null). Votes of one
judge on a cell count once, the first. A cell is met to the share of its votes if a quorum voted; else it is open and counts 0. A target reason that no
reason covers, or that one contradicts, scores 0 against a denominator of all target reasons of the unit, so leaving reasons out never helps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values of the contract
VOTES, QUORUM = 5, 3
COMPONENTS = ["target_reason_coverage", "evidence_grounding", "inferential_link", "answer_consistency"]
FLAGS = ["valid_grounded_premise", "has_answer_implication", "contradiction"]
BASE, PER_ANALYSIS, BONUS = -0.27, 1.27, 0.25


def cells(votes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cast, met, share, agreement and open of each cell of votes (keys, judge, seat, vote): what a panel makes of it.

    seat orders a judge's repeated votes; agreement is the share of votes on the larger side. Votes that are dealt by some of the keys already aren't shuffled.
    """
    once = votes.groupBy(*keys, "judge").agg(F.min_by("vote", "seat").alias("vote"))
    counted = once.groupBy(*keys).agg(F.count("vote").cast("int").alias("cast"), F.coalesce(F.sum("vote"), F.lit(0)).cast("int").alias("met"))
    share = F.col("met") / F.col("cast")
    decided = F.col("cast") >= QUORUM
    return counted.select(*keys, "cast", "met", F.when(decided, share).otherwise(0.0).alias("share"), F.when(F.col("cast") > 0, F.greatest(share, 1 - share)).alias("agreement"), (~decided).alias("open"))


def _of(name: str) -> Column:
    return F.coalesce(F.max(F.when(F.col("component") == name, F.col("share"))), F.lit(0.0))


def target_scores(judged: DataFrame, checked: DataFrame, keys: list[str]) -> DataFrame:
    """The score of each target reason of judged (keys, target, component, share); checked (keys, target, consistent) is what the scorer could test itself.

    The mean of the four components, answer_consistency being the scorer's own test where it isn't null. 0 without coverage, without a grounded premise
    or an implication by a majority, and where a majority sees a contradiction.
    """
    wide = judged.groupBy(*keys, "target").agg(*[_of(c).alias(c) for c in COMPONENTS + FLAGS])
    joined = wide.join(checked, [*keys, "target"], "left")
    consistency = F.coalesce(F.col("consistent").cast("double"), F.col("answer_consistency"))
    mean = (sum((F.col(c) for c in COMPONENTS[:3]), F.lit(0.0)) + consistency) / len(COMPONENTS)
    void = (F.col("target_reason_coverage") <= 0.5) | (F.col("valid_grounded_premise") <= 0.5) | (F.col("has_answer_implication") <= 0.5) | (F.col("contradiction") > 0.5)
    return joined.select(*keys, "target", *COMPONENTS[:3], consistency.alias("answer_consistency"), void.alias("void"), F.when(void, 0.0).otherwise(mean).alias("score"))


def reasoning(scores: DataFrame, targets: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """keys, targets and reasoning of each answer: the mean over all target reasons of its unit (targets: on, target), unjudged ones at 0.

    An answer that has no judged reason is not a row here; it adds no bonus.
    """
    every = targets.groupBy(*on).agg(F.count_distinct("target").alias("targets"))
    got = scores.groupBy(*keys).agg(F.sum("score").alias("total"))
    return got.join(every, on).select(*keys, "targets", F.least(F.col("total") / F.col("targets"), F.lit(1.0)).alias("reasoning"))


def final_score(analysis: Column, reasoning: Column) -> Column:
    """The old leaderboard scale with the bonus of the reasons on top; no reasons add nothing."""
    return BASE + PER_ANALYSIS * analysis + BONUS * F.coalesce(reasoning, F.lit(0.0))
