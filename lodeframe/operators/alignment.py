"""Holding predictions against a trusted roster: who must be there, and in which form.

Tables: roster (keys, entity_id, pos), predictions (keys, entity_id, ...). Keys are those of one answer, e.g.
submission_id and unit_id; all operators work on any number of answers at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# fixed values of the contract: limits, and the reasons of the roster check in their order of precedence
MOST_CLAIMS, CLAIM_CHARS = 20, 4000
ROSTER_REASONS = ["malformed", "duplicate", "unknown", "missing"]


def finite(x: Column) -> Column:
    """A number that is neither missing, nor NaN, nor infinite."""
    x = x.try_cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def build_roster(tasks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, entity_id and pos from tasks (keys, entities: an ordered array of ids)."""
    return tasks.select(*keys, F.posexplode("entities").alias("pos", "entity_id"))


def roster_faults(roster: DataFrame, keys: list[str]) -> DataFrame:
    """Rosters that can't be trusted: empty ids, repeated ids, ids that aren't in composed form where that is visible."""
    return roster.groupBy(*keys).agg(F.count_if(F.coalesce(F.trim("entity_id"), F.lit("")) == "").alias("n_empty"), (F.count("entity_id") - F.count_distinct("entity_id")).alias("n_repeated")).filter("n_empty > 0 or n_repeated > 0")


def vocabulary_fault(labels: Column, target_type: Column) -> Column:
    """Why a closed vocabulary is refused; null if it is sound. Only classification has one."""
    return (
        F.when((target_type != "classification") & labels.isNotNull(), "labels_without_classification")
        .when(target_type != "classification", None)
        .when(labels.isNull() | (F.size(labels) < 2), "too_few")
        .when(F.exists(labels, lambda x: x.isNull() | (F.trim(x) == "")), "empty")
        .when(F.exists(labels, lambda x: F.trim(x) != x), "padded")
        .when(F.size(F.array_distinct(labels)) < F.size(labels), "repeated")
    )


def roster_check(roster: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """For each answer the counts of malformed, duplicate, unknown and missing rows, and the first reason that applies.

    One aggregate over the union of both sides does for a full outer join: each id's rows meet once.
    """
    both = roster.select(*keys, "entity_id", F.lit(1).alias("r"), F.lit(0).alias("p")).unionByName(predictions.select(*keys, "entity_id", F.lit(0).alias("r"), F.lit(1).alias("p")))
    each = both.groupBy(*keys, "entity_id").agg(F.sum("r").alias("r"), F.sum("p").alias("p"))
    blank = F.coalesce(F.trim("entity_id"), F.lit("")) == ""
    counted = each.groupBy(*keys).agg(
        F.sum(F.when(blank, F.col("p")).otherwise(0)).alias("malformed"),
        F.sum(F.when(~blank & (F.col("p") > 1), F.col("p") - 1).otherwise(0)).alias("duplicate"),
        F.count_if(~blank & (F.col("r") == 0)).alias("unknown"),
        F.count_if(~blank & (F.col("p") == 0)).alias("missing"),
    )
    return counted.withColumn("reason", F.coalesce(*[F.when(F.col(x) > 0, x) for x in ROSTER_REASONS]))


def align(roster: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each roster entry, with the prediction or nulls. The roster is the denominator: no row is lost."""
    return roster.join(predictions, [*keys, "entity_id"], "left")


def interval_fault(low: Column, high: Column, level: Column, required: Column) -> Column:
    """Why an interval is refused; null if it is sound."""
    return (
        F.when(low.isNull() & high.isNull() & level.isNull(), "interval_absent")
        .when(~finite(level) | (level != required), "level_mismatch")
        .when(~finite(low) | ~finite(high), "not_finite")
        .when(low > high, "reversed")
    )


def rank_fault(df: DataFrame, keys: list[str]) -> DataFrame:
    """Whether ranks are all absent (fine) or a permutation of 1..n, for each answer."""
    got = F.array_sort(F.collect_list("rank"))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("n"), F.count("rank").alias("ranked"), got.alias("got")).select(*keys, F.when(F.col("ranked") == 0, None).when(F.col("ranked") < F.col("n"), "partial_ranks").when(F.col("got") != F.sequence(F.lit(1), F.col("n")), "not_a_permutation").alias("rank_fault"))


def whole_offset(value: Column) -> tuple[Column, Column]:
    """(offset, malformed) of a raw JSON number given as text: 120 and 120.0 are 120; 120.5, true and "120" are refused, null stays null."""
    number = value.rlike(r"^-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$")
    as_double = F.when(number, value).try_cast("double")
    whole = number & (as_double == F.floor(as_double))
    return F.when(whole, as_double.cast("int")), value.isNotNull() & (value != "null") & ~F.coalesce(whole, F.lit(False))


def explode_claims(predictions: DataFrame, keys: list[str], most: int = MOST_CLAIMS) -> DataFrame:
    """A row for each claim (doc_id, span_start, span_end, claim) with its place; only the first `most` of an entity count.

    The array is cut before it is exploded, so nothing past the cap is carried. `ignored` counts what was cut.
    """
    kept = F.slice("claims", 1, most)
    ignored = F.greatest(F.size("claims") - most, F.lit(0))
    return predictions.select(*keys, "entity_id", ignored.alias("ignored"), F.posexplode(kept).alias("claim_pos", "c")).select(*keys, "entity_id", "ignored", "claim_pos", "c.*")


def first_claims(claims: DataFrame, keys: list[str], order: str, most: int = MOST_CLAIMS) -> DataFrame:
    """The same cap where claims are rows already, one for each citation; the window's limit is pushed below its shuffle."""
    place = F.dense_rank().over(W.partitionBy(*keys).orderBy(order))
    return claims.withColumn("claim_place", place).filter(F.col("claim_place") <= most)


def claim_text(claim: Column, text: Column) -> tuple[Column, Column]:
    """(text, malformed): the claim, or else the legacy text, without outer white space; empty or too long is malformed."""
    stripped = F.regexp_replace(F.coalesce(claim, text), r"(?U)^\s+|\s+$", "")
    return stripped, F.coalesce(stripped == "", F.lit(True)) | (F.length(stripped) > CLAIM_CHARS)


def merged(plan: Column, card: Column, default: Column) -> tuple[Column, Column]:
    """(value, conflict) of a parameter: the plan outranks the card, the card the default; stated values must agree."""
    return F.coalesce(plan, card, default), plan.isNotNull() & card.isNotNull() & ~plan.eqNullSafe(card)


def truth_fault(aligned: DataFrame, keys: list[str]) -> DataFrame:
    """Whether the truth covers the roster, and numeric truth is complete or absent, for each answer."""
    n, y = F.count(F.lit(1)), F.count("y")
    bad = F.count_if(F.col("y").isNotNull() & ~finite(F.col("y")))
    uncovered = F.count_if(F.col("y").isNull() & F.col("true_label").isNull())
    numeric = F.max(F.col("target_type").isin("regression", "ranking"))
    return aligned.groupBy(*keys).agg(F.when(uncovered > 0, "uncovered").when(bad > 0, "not_finite").when((y > 0) & (y < n), "partly_numeric").when(numeric & (y < n), "numeric_truth_required").alias("truth_fault"))


def schema_faults(answer: Column) -> Column:
    """How many required parts a parsed answer lacks: ids, intervals with their three numbers, and claims with their four parts."""
    lacks = lambda *xs: sum((x.isNull().cast("int") for x in xs), F.lit(0))
    claim = lambda c: lacks(c["doc_id"], c["span_start"], c["span_end"], F.coalesce(c["claim"], c["text"]))
    total = lambda xs: F.coalesce(F.aggregate(xs, F.lit(0), lambda a, x: a + x), F.lit(0))
    row = lambda r: lacks(r["entity_id"], r["interval"]["level"], r["interval"]["lo"], r["interval"]["hi"]) + (F.coalesce(F.size(r["claims"]), F.lit(0)) <= 0).cast("int") + total(F.transform(r["claims"], claim))
    return lacks(answer["task_id"]) + (F.coalesce(F.size(answer["entity_predictions"]), F.lit(0)) <= 0).cast("int") + total(F.transform(answer["entity_predictions"], row))
