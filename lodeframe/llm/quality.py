"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is encoded as a vector of features that can be read
anywhere in a text: kinds of bytes, word lengths, repetition inside the passage and of earlier passages, and hashed
byte pairs. Gated attention, a softmax over passages of w . (tanh(Vh) * sigmoid(Uh)), weighs the encoded passages h;
the weighted mean gives the score. The weights are learned from document labels alone, so the attention finds
the passages that make a document bad, however long the rest is.

Training is bounded: PER_CLASS texts of each label, at most SAMPLE_BYTES bytes each. Scoring reads whole texts.

Defined cases: a null or empty text is one passage of zero features; a row with a null doc_id is scored and not held
out; repeated rows get one score each; with labels of one class only, or none, every score is the smoothed share
of good labels in the sample; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.llm import textkit as tk
from lodeframe.llm.store import bounded_batches
from lodeframe.llm.training import labelled_sample

PASSAGE = 48
PER_CLASS, SAMPLE_BYTES = 1500, 24_000
PAIRS = 24
HIDDEN, GATE, STEPS = 24, 12, 1500

_KINDS = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " ", "\n\r", ".", ",;:", "!?", "|", "#$%&*~^=+<>@_\\/", "()[]{}\"'`-"]
_KIND = np.full(256, len(_KINDS), np.uint8)
for _k, _chars in enumerate(_KINDS):
    _KIND[[ord(c) for c in _chars]] = _k
N_KINDS = len(_KINDS) + 1
N_FEATURES = N_KINDS + PAIRS + 9


def passages(part: tk.Slice) -> tuple[np.ndarray, np.ndarray]:
    """The features of each passage of a slice, and how many passages each row has (one at least)."""
    words = part.words()
    counts = np.maximum(1, -(-words.count // PASSAGE))
    total = int(counts.sum())
    first = np.cumsum(counts) - counts  # of each row's passages
    out = np.zeros((total, N_FEATURES), np.float32)
    if not len(words.start):
        return out, counts
    inside = np.arange(len(words.start)) - words.first[words.row]
    of = first[words.row] + inside // PASSAGE  # the passage of each word
    n = np.bincount(of, minlength=total).astype(np.float64)
    safe = np.maximum(n, 1)
    # bytes belong to the passage of the last word that began
    owner = np.zeros(len(part.data), np.int64)
    owner[words.start] = 1
    word_at = np.maximum(np.cumsum(owner) - 1, 0)
    byte_of = of[word_at]
    size = np.maximum(np.bincount(byte_of, minlength=total), 1)
    kinds = np.bincount(byte_of * N_KINDS + _KIND[part.data], minlength=total * N_KINDS).reshape(total, N_KINDS)
    out[:, :N_KINDS] = np.sqrt(kinds / size[:, None])
    if len(part.data) > 1:
        pair = (part.data[:-1].astype(np.uint32) * np.uint32(0x9E37) + part.data[1:].astype(np.uint32) * np.uint32(0x79B1)) % np.uint32(65521) % np.uint32(PAIRS)
        found = np.bincount(byte_of[:-1] * PAIRS + pair, minlength=total * PAIRS).reshape(total, PAIRS)
        out[:, N_KINDS : N_KINDS + PAIRS] = np.sqrt(found / size[:, None])
    hashes = words.hashes()
    length = words.end - words.start
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (words.row[1:] == words.row[:-1])
    order = np.lexsort((hashes, words.row))
    h, r = hashes[order], words.row[order]
    again = np.zeros(len(hashes), bool)  # the word stood in the row before
    again[order[1:]] = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
    inner = np.lexsort((hashes, of))
    h, r = hashes[inner], of[inner]
    repeated = np.zeros(len(hashes), bool)  # it stood in the passage before
    repeated[inner[1:]] = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
    grams = tk.rolling(hashes, 3)
    seen = np.zeros(len(hashes), bool)  # the word begins a run of three that the row had before
    if len(grams):
        row = words.row[: len(grams)]
        order = np.lexsort((grams, row))
        g, r = grams[order], row[order]
        seen[order[1:]] = (g[1:] == g[:-1]) & (r[1:] == r[:-1])
    mean = lambda x: np.bincount(of, weights=x, minlength=total) / safe
    average = mean(length)
    extra = [np.log1p(n) / 4, np.log1p(average) / 2, np.log1p(np.sqrt(np.maximum(mean(length.astype(float) ** 2) - average**2, 0))) / 2, mean(same), mean(again), mean(repeated), mean(seen), mean(length <= 2), np.log1p(counts)[np.repeat(np.arange(part.rows), counts)] / 4]
    out[:, N_KINDS + PAIRS :] = np.column_stack(extra)
    return out, counts


@dataclass(frozen=True)
class Model:
    """scale and shift of features; encoder e; attention v, u, a; output o."""

    shift: np.ndarray
    scale: np.ndarray
    values: dict[str, np.ndarray]

    def scores(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return _forward(self.values, (x - self.shift) * self.scale, _bags(counts))["p"]


def _bags(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each bag begins, and the bag of each passage."""
    return np.cumsum(counts) - counts, np.repeat(np.arange(len(counts)), counts)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(w: dict[str, np.ndarray], x: np.ndarray, bags: tuple[np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
    begin, of = bags
    h = np.tanh(x @ w["e"] + w["eb"])
    t, g = np.tanh(h @ w["v"]), _sigmoid(h @ w["u"])
    s = (t * g) @ w["a"]
    s = np.exp(s - np.maximum.reduceat(s, begin)[of])
    weight = s / np.add.reduceat(s, begin)[of]
    z = np.add.reduceat(weight[:, None] * h, begin, axis=0)
    return {"h": h, "t": t, "g": g, "weight": weight, "z": z, "p": _sigmoid(z @ w["o"] + w["ob"])}


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, importance: np.ndarray, bags: tuple[np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
    """Of the weighted cross-entropy, by hand-made backpropagation."""
    begin, of = bags
    f = _forward(w, x, bags)
    d = (f["p"] - y) * importance
    dz = d[:, None] * w["o"]
    back = (dz[of] * f["h"]).sum(axis=1)
    ds = f["weight"] * (back - np.add.reduceat(f["weight"] * back, begin)[of])
    dt = ds[:, None] * w["a"] * f["g"] * (1 - f["t"] ** 2)
    dg = ds[:, None] * w["a"] * f["t"] * f["g"] * (1 - f["g"])
    dh = (f["weight"][:, None] * dz[of] + dt @ w["v"].T + dg @ w["u"].T) * (1 - f["h"] ** 2)
    return {"e": x.T @ dh, "eb": dh.sum(axis=0), "v": f["h"].T @ dt, "u": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ ds, "o": f["z"].T @ d, "ob": d.sum(keepdims=True)}


def fit(sample: list[tuple[str, int]], steps: int = STEPS, batch: int = 128) -> Model | float:
    """Adam on seeded batches; classes weigh the same. The smoothed share of label 1 if a class has no text."""
    y = np.array([label for _, label in sample], float)
    if not len(y) or y.min() == y.max():
        return float((y.sum() + 1) / (len(y) + 2))
    parts = [passages(part) for part in tk.slices(pa.array([text for text, _ in sample], pa.string()))]
    x, counts = np.concatenate([p for p, _ in parts]).astype(np.float64), np.concatenate([c for _, c in parts])
    shift, scale = x.mean(axis=0), 1 / (x.std(axis=0) + 1e-3)
    x = (x - shift) * scale
    rng = np.random.default_rng(17)
    shapes = {"e": (x.shape[1], HIDDEN), "eb": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "a": (GATE,), "o": (HIDDEN,), "ob": (1,)}
    w = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if k[-1] != "b" or k == "b" else np.zeros(s) for k, s in shapes.items()}
    mean, square = ({k: np.zeros(s) for k, s in shapes.items()} for _ in range(2))
    begin, _ = _bags(counts)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for step in range(1, steps + 1):
        rows = rng.choice(len(y), min(batch, len(y)), replace=False)
        of = np.concatenate([np.arange(begin[r], begin[r] + counts[r]) for r in rows])
        grads = _gradients(w, x[of], y[rows], weight[rows] / len(rows), _bags(counts[rows]))
        rate = 0.01 * min(1.0, 2 * (1 - (step - 1) / steps))
        for k in w:
            g = grads[k] + 2e-4 * w[k]
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.999 * square[k] + 0.001 * g * g
            w[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return Model(shift, scale, w)


def score_texts(model: Model | float, column: pa.Array) -> np.ndarray:
    if not isinstance(model, Model):
        return np.full(len(column), model)
    return np.concatenate([model.scores(*passages(part)) for part in tk.slices(column)] or [np.empty(0)])


def quality(documents: DataFrame, labels: DataFrame, usable: Column, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id and score of each row; the model is fitted on labels.quality of ids for which usable holds."""
    bounded_batches(documents.sparkSession)
    model = documents.sparkSession.sparkContext.broadcast(fit(labelled_sample(documents, labels, "quality", usable, per_class, SAMPLE_BYTES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(score_texts(model.value, tk.text_column(batch, "text")), pa.float64())], ["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def annotate(documents: DataFrame, labels: DataFrame, usable: Column, name: str = "quality_score", per_class: int = PER_CLASS) -> DataFrame:
    """All rows and columns of documents, with the score in the new column name; rows don't move."""
    if name.lower() in (c.lower() for c in documents.columns):
        raise ValueError(f"documents have a column {name}")
    at = {c.lower(): i for i, c in enumerate(documents.columns)}
    bounded_batches(documents.sparkSession)
    model = documents.sparkSession.sparkContext.broadcast(fit(labelled_sample(documents, labels, "quality", usable, per_class, SAMPLE_BYTES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(score_texts(model.value, batch.column(at["text"]).cast(pa.string())), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, name])

    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, T.StructField(name, T.DoubleType())]))
