"""Quality by a factorisation machine over hashed words, structure statistics and metadata of a text."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeledger.llm.labelled import fit, training_sample
from changeledger.llm.texts import WordHashes, bucket, encoded, words

#: Upper edges of the classes into which a statistic falls; each class is a feature of its own.
EDGES = np.array([0.0, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 1.0])
STATISTICS = 14
#: Most labelled texts that the model is fitted on, chosen by a hash of their id.
TRAINING_ROWS = 12_000
_LETTERS = bytes(c for c in range(256) if c >= 128 or chr(c).isalpha())
_UPPER, _DIGITS, _MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?"
_SIGNS = bytes(c for c in range(33, 128) if not chr(c).isalnum() and c not in _MARKS)


@dataclass(frozen=True)
class Settings:
    """rank: factors of a feature; rate: AdaGrad's; word_share: weight of all words together against the statistics."""

    bits: int = 16
    rank: int = 8
    rate: float = 0.1
    l2: float = 1e-5
    passes: int = 6
    word_share: float = 1.0
    seed: int = 7


def _share(characters: bytes, text: bytes) -> float:
    return (len(text) - len(text.translate(None, characters))) / max(1, len(text))


def statistics(text: bytes, found: list[bytes]) -> list[float]:
    """Structure and metadata of a text, each 0 to 1."""
    lines, counts = text.split(b"\n"), Counter(found)
    n = max(1, len(found))
    pairs = len(set(zip(found, found[1:])))
    return [
        _share(_LETTERS, text), _share(_UPPER, text), _share(_DIGITS, text), _share(_MARKS, text), _share(_SIGNS, text),
        len(counts) / n,                                                    # variety of words
        max(counts.values(), default=0) / n,                                # the most frequent word
        pairs / n,                                                          # variety of neighbours
        sum(map(eq, found, found[1:])) / n,                                 # words said twice
        len(set(lines)) / len(lines),                                       # variety of lines
        min(1.0, sum(map(len, found)) / n / 20),                            # word length
        min(1.0, np.log1p(n) / 12),                                         # words of the text
        min(1.0, np.log1p(len(text)) / 16),                                 # bytes of the text
        min(1.0, np.log1p(len(text) / len(lines)) / 12),                    # bytes of a line
    ]


def features(text: bytes, known: WordHashes, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values: words by the logarithm of their count, of length word_share together;
    behind them one feature of value 1 for the class of each statistic."""
    found = words(text)
    size = 1 << settings.bits
    at, counts = np.unique(bucket(known.of(found), settings.bits), return_counts=True)
    value = np.log1p(counts)
    if len(at):
        value *= settings.word_share / np.sqrt((value * value).sum())
    stats = np.array(statistics(text, found))
    classes = size + np.arange(STATISTICS) * (len(EDGES) + 1) + np.searchsorted(EDGES, stats)
    return np.concatenate([at, classes]).astype(np.int32), np.concatenate([value, np.full(STATISTICS, 1 / np.sqrt(STATISTICS))]).astype(np.float32)


def width(settings: Settings) -> int:
    return (1 << settings.bits) + STATISTICS * (len(EDGES) + 1)


def raw_score(at: np.ndarray, value: np.ndarray, constant: float, weights: np.ndarray, factors: np.ndarray) -> tuple[float, np.ndarray]:
    """Constant + linear part + half of (square of sums - sum of squares): all pairs in linear time."""
    parts = factors[at] * value[:, None]
    sums = parts.sum(0)
    return float(constant + weights[at] @ value + 0.5 * (sums @ sums - np.einsum("ij,ij->", parts, parts))), sums


def probability(score: float) -> float:
    return float(1 / (1 + np.exp(-min(35.0, max(-35.0, score)))))


def train(batches: Iterator[pa.RecordBatch], settings: Settings) -> tuple[float, np.ndarray, np.ndarray]:
    known, examples = WordHashes(), []
    for batch in batches:
        for text, target in zip(encoded(batch.column("text")), batch.column("target").to_pylist()):
            examples.append((*features(text, known, settings), target))
    random, size = np.random.default_rng(settings.seed), width(settings)
    constant, weights = 0.0, np.zeros(size, np.float32)
    factors = random.normal(0, 0.05, (size, settings.rank)).astype(np.float32)
    seen_w, seen_f, seen_c = np.full(size, 1e-6, np.float32), np.full((size, settings.rank), 1e-6, np.float32), 1e-6
    for _ in range(settings.passes):
        for k in random.permutation(len(examples)):
            at, value, target = examples[k]
            score, sums = raw_score(at, value, constant, weights, factors)
            error = probability(score) - target
            own = factors[at]
            grad_w = error * value + settings.l2 * weights[at]
            grad_f = error * (value[:, None] * sums - own * (value * value)[:, None]) + settings.l2 * own
            seen_w[at] += grad_w * grad_w
            seen_f[at] += grad_f * grad_f
            seen_c += error * error
            weights[at] -= settings.rate * grad_w / np.sqrt(seen_w[at])
            factors[at] = own - settings.rate * grad_f / np.sqrt(seen_f[at])
            constant -= settings.rate * error / np.sqrt(seen_c)
    return constant, weights, factors


def _tables(data: bytes, size: int, rank: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(data, np.float32, size), np.frombuffer(data, np.float32, size * rank, 4 * size).reshape(size, rank)


@dataclass(frozen=True)
class Model:
    """Weights and factors; 4 * width * (rank + 1) bytes whatever the table, broadcast to the executors."""

    tables: bytes
    constant: float
    settings: Settings

    def score(self, text: Column) -> Column:
        """Probability of good quality (double, 0 to 1). NULL is the empty text; no text is cut."""
        from pyspark.sql import SparkSession

        sent = SparkSession.active().sparkContext.broadcast(self.tables)
        constant, settings = self.constant, self.settings

        @F.arrow_udf("double")
        def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            weights, factors = _tables(sent.value, width(settings), settings.rank)
            known = WordHashes()
            for batch in batches:
                yield pa.array([probability(raw_score(*features(t, known, settings), constant, weights, factors)[0])
                                for t in encoded(batch)], pa.float64())

        return scored(text)


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column, settings: Settings = Settings(), rows: int = TRAINING_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents (labels: doc_id, quality) for which ``learn`` holds.

    Defined results: without labelled documents every score is near 0.5; other columns of both tables are
    not read.
    """
    constant, weights, factors = fit(training_sample(docs, labels, "quality", learn, rows), lambda batches: train(batches, settings))
    return Model(weights.tobytes() + factors.tobytes(), constant, settings)
