"""What of a failed answer is published: a label, one of a closed list of codes, and counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the contract: the public label of each reason, the codes of those that have one, and the counts that may be published
LABELS = {
    "no_answer": "schema_invalid_output",
    "malformed_answer": "schema_invalid_output",
    "not_json": "schema_invalid_output",
    "non_finite": "schema_invalid_output",
    "schema": "schema_invalid_output",
    "task_mismatch": "schema_invalid_output",
    "target_mismatch": "schema_invalid_output",
    "missing": "schema_invalid_output",
    "unknown": "schema_invalid_output",
    "duplicate": "schema_invalid_output",
    "malformed": "schema_invalid_output",
    "not_finite": "schema_invalid_output",
    "point_missing": "schema_invalid_output",
    "level_mismatch": "schema_invalid_output",
    "label_outside": "schema_invalid_output",
    "interval_absent": "t4_miscalibrated_interval",
    "reversed": "t4_miscalibrated_interval",
    "bad_offsets": "t4_unfaithful_citation",
    "no_claims": "t4_unfaithful_citation",
    "unresolved": "t4_unfaithful_citation",
    "undated": "t4_stale_evidence",
    "post_cutoff": "t4_stale_evidence",
}
CODES = {"no_answer": "no_output", "malformed_answer": "malformed_output", "not_json": "malformed_output", "non_finite": "malformed_output", "schema": "schema_invalid", "undated": "cutoff_violation", "post_cutoff": "cutoff_violation", "missing": "incomplete_output"}
DEFAULT_CODE = "domain_gate_failed"
COUNTS = ["missing_count", "extra_count", "invalid_row_count", "nonfinite_count", "expected_count", "observed_count", "violation_count"]


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def public_label(reason: Column) -> Column:
    """The label of a reason; null for none and for one that isn't known."""
    return F.when(reason.isNotNull(), _lookup(LABELS, reason))


def public_code(reason: Column) -> Column:
    """The code of a reason: a failure without a code of its own failed a gate of its domain."""
    return F.when(reason.isNotNull(), F.coalesce(_lookup(CODES, reason), F.lit(DEFAULT_CODE)))


def public_detail(reason: Column, counts: dict[str, Column]) -> Column:
    """A struct of the code and whole counts, null for a sound answer. The reason itself stays private, and so does any other key: ValueError."""
    if set(counts) - set(COUNTS):
        raise ValueError(f"not public: {sorted(set(counts) - set(COUNTS))}")
    return F.when(reason.isNotNull(), F.struct(public_code(reason).alias("code"), *[n.cast("long").alias(name) for name, n in counts.items()]))
