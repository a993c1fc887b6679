"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeledger.llm.labelled import fit, training_sample
from changeledger.llm.texts import WordHashes, bucket, encoded, joined, words

#: Words of a text that are turned into features at a time; what overlaps is two words.
SPAN = 200_000
#: Most labelled texts that the model is fitted on, chosen by a hash of their id.
TRAINING_ROWS = 20_000


@dataclass(frozen=True)
class Settings:
    """alpha, beta: rate of a coordinate, alpha / (beta + sqrt(sum of squared gradients)); l1, l2: penalties."""

    bits: int = 22
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 20.0
    l2: float = 0.1
    passes: int = 10


def features(text: bytes, known: WordHashes, bits: int) -> np.ndarray:
    """The different buckets of all words, pairs of neighbours, and pairs with one word between (skip-grams).

    Punctuation at the ends of a word does not count, so that a word is the same at the end of a sentence.
    """
    found = [w.strip(b".,;:!?\"'()[]*#%$&") for w in words(text)]
    parts = []
    for start in range(0, len(found), SPAN):
        h = known.of(found[start:start + SPAN + 2])
        parts += [bucket(h, bits), bucket(joined(h[:-1], h[1:]), bits), bucket(joined(h[:-2], h[2:] ^ np.uint64(1)), bits)]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int64)


def probability(score: float) -> float:
    return float(1 / (1 + np.exp(-min(35.0, max(-35.0, score)))))


def train(batches: Iterator[pa.RecordBatch], settings: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets with weights, their weights, and the weight of the constant. Without examples: nothing, 0."""
    known, examples = WordHashes(), []
    for batch in batches:
        targets = batch.column("target").to_pylist()
        for text, target in zip(encoded(batch.column("text")), targets):
            examples.append((features(text, known, settings.bits).astype(np.int32), target))
    size = 1 << settings.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        out = -(zs - np.sign(zs) * settings.l1) / ((settings.beta + np.sqrt(n[at])) / settings.alpha + settings.l2)
        return np.where(np.abs(zs) <= settings.l1, 0.0, out)

    for _ in range(settings.passes):
        for found, target in examples:
            at = np.append(found, size)
            w = weights(at)
            gradient = probability(w.sum()) - target
            square = gradient * gradient
            sigma = (np.sqrt(n[at] + square) - np.sqrt(n[at])) / settings.alpha
            z[at] += gradient - sigma * w
            n[at] += square
    final = weights(np.arange(size + 1))
    at = np.flatnonzero(final[:size])
    return at.astype(np.int32), final[at].astype(np.float32), float(final[size])


def _dense(key: bytes, bits: int) -> np.ndarray:
    count = len(key) // 8
    at, values = np.frombuffer(key, np.int32, count), np.frombuffer(key, np.float32, count, 4 * count)
    table = np.zeros(1 << bits, np.float32)
    table[at] = values
    return table


@dataclass(frozen=True)
class Model:
    """Sparse weights as bytes: buckets, then values. A few thousand entries; it travels with the tasks."""

    weights: bytes
    constant: float
    settings: Settings

    def score(self, text: Column) -> Column:
        """Probability that a text is toxic (double, 0 to 1). NULL is the empty text; no text is cut."""
        sparse, constant, bits = self.weights, self.constant, self.settings.bits

        @F.arrow_udf("double")
        def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            table, known = _dense(sparse, bits), WordHashes()
            for batch in batches:
                yield pa.array([probability(table[features(t, known, bits)].sum(dtype=np.float64) + constant)
                                for t in encoded(batch)], pa.float64())

        return scored(text)


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, settings: Settings = Settings(), rows: int = TRAINING_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents (labels: doc_id, toxic) for which ``learn`` holds.

    L1 leaves few weights, so the model is small whatever the table. Defined results: without labelled
    documents the model scores every text 0.5; other columns of both tables are not read.
    """
    at, values, constant = fit(training_sample(docs, labels, "toxic", learn, rows), lambda batches: train(batches, settings))
    return Model(at.tobytes() + values.tobytes(), constant, settings)


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows whose score is below the threshold; all columns stay as they are."""
    return docs.filter(model.score(F.col(text)) < threshold)
