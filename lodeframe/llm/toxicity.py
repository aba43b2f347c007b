"""Toxicity by compression distance: zstandard dictionaries of toxic and ordinary text.

Both dictionaries hold the commonest words of the sample. The toxic one also holds the words of toxic texts that carry
distinctive byte n-grams: those of many more toxic than ordinary texts. The lower the ratio, the surer the difference has to be: a
language with few texts has telling n-grams that its ordinary texts hold too, at a low ratio over all texts. A window of text is compressed with each; the
difference of the lengths is what the toxic dictionary explains that the ordinary one doesn't.

A window is one word (a run of at most WINDOW_BYTES bytes between white space, lower case), set between
two carriers that both dictionaries hold. Longer windows drown a word in the noise of the parse, and a bare short
one is stored as it is; the carriers make every byte of the word count. Saved bytes and the saved share are
calibrated thresholds: the number of windows beyond each feeds a logistic regression that gives the score.

The sample is bounded: PER_CLASS texts of each label, at most SAMPLE_BYTES bytes each. Scoring reads whole texts; words
recur, so their lengths are kept in a bounded cache.

Defined cases: a null or empty text has no window and gets the score of that; a row with a null doc_id is
scored and not held out; repeated rows get one score each; with labels of one class only, or none, every score is
the smoothed share of toxic labels in the sample; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.llm import textkit as tk
from lodeframe.llm.store import bounded_batches
from lodeframe.llm.training import labelled_sample, logistic

PER_CLASS, SAMPLE_BYTES = 1000, 16_000
GRAM, LEAST_SHARE, LEAST_RATIO = 5, 0.02, 20
SURE_RATIO, SURE_Z = 3, 5
COMMON_WORDS, TOXIC_WORDS = 4000, 300
WINDOW_BYTES, LEVEL, CACHE = 40, 12, 300_000
CARRIER = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ#"
SAVED, SHARES = 9, 4


def windows(text: str) -> list[bytes]:
    """The words of a lower-cased text; a longer run is cut into pieces of WINDOW_BYTES."""
    found = text.lower().encode().split()
    if max(map(len, found), default=0) <= WINDOW_BYTES:
        return found
    return [w[i : i + WINDOW_BYTES] for w in found for i in range(0, len(w), WINDOW_BYTES)]


def telling(toxic: Counter, ordinary: Counter, n_toxic: int, n_plain: int) -> set[bytes]:
    """The n-grams that tell toxic texts, from the numbers of texts that hold each: by a large ratio, or a smaller one that is significant."""
    found = set()
    for g, n in toxic.items():
        ratio = n / n_toxic / ((ordinary[g] + 0.5) / n_plain)
        if n < max(3, LEAST_SHARE * n_toxic) or ratio < SURE_RATIO:
            continue
        p = (n + ordinary[g]) / (n_toxic + n_plain)
        spread = (p * (1 - p) * (1 / n_toxic + 1 / n_plain)) ** 0.5
        if ratio >= LEAST_RATIO or n / n_toxic - ordinary[g] / n_plain >= SURE_Z * spread:
            found.add(g)
    return found


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    bias: float


class Scorer(dict):
    """The class of a window, by saved bytes and saved share; 0: nothing saved."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard as z

        params = z.ZstdCompressionParameters.from_level(LEVEL, min_match=4, write_content_size=0, write_checksum=0, write_dict_id=0, source_size=64, dict_size=65536)
        made = []
        for content in (ordinary, toxic):
            words = z.ZstdCompressionDict(content + CARRIER, dict_type=z.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(compression_params=params)
            made.append(z.ZstdCompressor(dict_data=words, compression_params=params).compress)
        self._ordinary, self._toxic = made
        self._base = [len(f(CARRIER + CARRIER)) for f in made]

    def __missing__(self, word: bytes) -> int:
        window = b"".join((CARRIER, b" ", word, b" ", CARRIER))
        plain = len(self._ordinary(window)) - self._base[0]
        saved = plain - (len(self._toxic(window)) - self._base[1])
        found = min(saved, SAVED - 1) * SHARES + min(SHARES - 1, SHARES * saved // max(plain, 1)) if saved > 1 else 0
        if len(self) >= CACHE:
            self.clear()
        self[word] = found
        return found

    def features(self, text: str) -> np.ndarray:
        own = windows(text)
        hits = np.bincount(np.fromiter(map(self.__getitem__, own), np.int64, len(own)), minlength=SAVED * SHARES)[2 * SHARES :]
        n = max(1, len(own))
        return np.concatenate([np.log1p(hits), np.log1p(300 * hits / n), [np.log1p(n)]])


def fit(sample: list[tuple[str, int]]) -> Model | float:
    """A model, or the smoothed share of toxic texts if one class has no text."""
    texts = {of: [text for text, label in sample if label == of] for of in (0, 1)}
    if not texts[0] or not texts[1]:
        return (len(texts[1]) + 1) / (len(sample) + 2)
    grams: dict[int, Counter] = {}
    for of, own in texts.items():
        grams[of] = Counter()
        for text in own:
            grams[of].update({x[i : i + GRAM] for w in windows(text) for x in (b" " + w + b" ",) for i in range(max(1, len(x) - GRAM + 1))})
    told = telling(grams[1], grams[0], len(texts[1]), len(texts[0]))
    toxic, common = Counter(), Counter()
    for of, own in texts.items():
        for text in own:
            for w in windows(text):
                x = b" " + w + b" "
                tells = any(x[i : i + GRAM] in told for i in range(len(x) - GRAM + 1))
                if of or not tells:  # a word that tells is explained by the toxic dictionary only
                    (toxic if tells else common)[w] += 1
    content = lambda words, n: b"".join(b" " + w for w, _ in reversed(words.most_common(n)))  # noqa: E731  commonest last, where offsets are short
    ordinary = content(common, COMMON_WORDS)
    scorer = Scorer(ordinary, both := ordinary + content(toxic, TOXIC_WORDS))
    weights, bias = logistic(np.array([scorer.features(text) for text, _ in sample]), np.array([label for _, label in sample], float))
    return Model(ordinary, both, weights, bias)


_scorers: dict[int, tuple[Model, Scorer]] = {}


def score_texts(model: Model | float, texts: list[str]) -> np.ndarray:
    if not isinstance(model, Model):
        return np.full(len(texts), model)
    key = hash((model.ordinary, model.toxic))
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = (model, Scorer(model.ordinary, model.toxic))
    scorer = _scorers[key][1]
    return np.array([1 / (1 + np.exp(-np.clip(scorer.features(text) @ model.weights + model.bias, -30, 30))) for text in texts])


def toxicity(documents: DataFrame, labels: DataFrame, usable: Column, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id and score of each row; the model is fitted on labels.toxic of ids for which usable holds."""
    bounded_batches(documents.sparkSession)
    model = documents.sparkSession.sparkContext.broadcast(fit(labelled_sample(documents, labels, "toxic", usable, per_class, SAMPLE_BYTES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() or "" for x in tk.text_column(batch, "text")]
            yield pa.record_batch([batch.column(0), pa.array(score_texts(model.value, texts), pa.float64())], ["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
