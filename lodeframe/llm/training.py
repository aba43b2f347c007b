"""Bounded samples of labelled texts, and small models that are fitted on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.store import checkpoint


def fold(doc_id: str, modulus: int) -> Column:
    """The contract's fold: crc32 of the id as text, modulo modulus; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % modulus


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int, most_bytes: int) -> list[tuple[str, int]]:
    """At most per_class texts of each label, each of 1 to most_bytes bytes: those with the least hashes.

    usable is a condition on doc_id. An id with several labels counts with the largest, and so does a text. Equal texts count once, and each text
    of an id counts for itself. Only ids and hashes are joined and sorted; the chosen texts, and no others, are read by hash.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter(usable).groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sized = texts.filter(F.octet_length("text").between(1, most_bytes)).select("doc_id", F.xxhash64("text").alias("rank"), F.crc32("text").alias("check"))
    ranked = checkpoint(sized.join(known, "doc_id").groupBy("rank", "check").agg(F.max("label").alias("label")))
    least = lambda of: ranked.filter(F.col("label") == of).orderBy("rank", "check").limit(per_class)
    chosen = F.broadcast(least(0).union(least(1)))  # 2 * per_class rows at most
    own = texts.filter(F.octet_length("text").between(1, most_bytes)).select("text", F.xxhash64("text").alias("rank"), F.crc32("text").alias("check"))
    rows = own.join(chosen, ["rank", "check"]).groupBy("rank", "check", "label").agg(F.min("text").alias("text")).collect()
    return sorted((r.text, r.label) for r in rows)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 3e-3, steps: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression by Newton steps, in the units of x."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(len(w))
        w -= np.linalg.solve(hessian, z.T @ (p - y) / len(y) + ridge * w)
    return w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum())
