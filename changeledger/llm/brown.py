"""Language-model scores by a class bigram model; exchange clustering assigns words to classes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeledger.llm.common import settle
from changeledger.llm.texts import encoded, words

#: The end of a text as a token: no word is empty.
END = b""
#: Different tokens and pairs that a task counts before it hands them on.
HELD_WORDS, HELD_PAIRS = 200_000, 1_000_000
#: A word with this share of all tokens or more is dealt to so many parts; at most 1 / HOT_SHARE words are.
HOT_SHARE, HOT_PARTS = 0.002, 64
#: Exchange ends when two rounds bring no more than this share of all growth.
SMALL = 0.01
#: A pair of token numbers is one long number: the first is shifted by so many bits.
SHIFT = 31


@dataclass(frozen=True)
class Settings:
    """vocabulary: most words with a number of their own, the most frequent ones; the others are words of one class.

    classes: exchanged classes, beside that of the other words and that of the end. rounds: rounds of exchange.
    prior: weight of the class frequencies in a class's transitions.
    """

    vocabulary: int = 60_000
    classes: int = 48
    rounds: int = 8
    prior: float = 5.0


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["token", "n"])

    counts: Counter = Counter()
    for batch in batches:
        for text in encoded(batch.column("text")):
            counts.update(words(text))
            counts[END] += 1
            if len(counts) > HELD_WORDS:
                yield rows(counts)
                counts.clear()
    if counts:
        yield rows(counts)


def token_counts(texts: DataFrame) -> DataFrame:
    """token (binary), n over all texts; every text ends with one END."""
    return texts.select("text").mapInArrow(_count_tokens, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def head_of(counts: DataFrame, most: int) -> DataFrame:
    """The ``most`` most frequent words, ties by the word itself. END is not a word.

    Spark takes the first of each part of the table before it takes the first of all.
    """
    return counts.filter(F.length("token") > 0).orderBy(F.col("n").desc(), "token").limit(most).select("token", "n")


class Numbers(dict):
    """Number of a token; unknown words have the number after the last."""

    def __init__(self, tokens: list[bytes]):
        super().__init__(zip(tokens, range(len(tokens))))
        self.other, self.end = len(tokens), len(tokens) + 1
        self[END] = self.end

    def __missing__(self, token: bytes) -> int:
        return self.other

    def of(self, text: bytes) -> np.ndarray:
        found = words(text)
        return np.fromiter(map(self.__getitem__, found), np.int64, len(found))


def _count_pairs(batches: Iterator[pa.RecordBatch], tokens: Broadcast) -> Iterator[pa.RecordBatch]:
    numbers, held, size = Numbers(tokens.value), [], 0

    def rows() -> pa.RecordBatch:
        pairs, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n.astype(np.int64))], ["pair", "n"])

    for batch in batches:
        for text in encoded(batch.column("text")):
            line = np.concatenate([[numbers.end], numbers.of(text), [numbers.end]])
            held.append(line[:-1] << SHIFT | line[1:])
            size += len(line) - 1
            if size > HELD_PAIRS:
                yield rows()
                held, size = [], 0
    if held:
        yield rows()


def _weighed(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def _exchanged(batches: Iterator[pa.RecordBatch], own: np.ndarray, matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
    """word, class: the class into which each word of these rows would be moved.

    Rows: word and near, its counts with the classes that follow it (c < k) and precede it (c - k). The gain
    of a class is the growth of the sum of n log n over class pairs less that over left and right classes,
    after the word has been taken out of its class.
    """
    k = len(matrix)
    for batch in batches:
        word, near = batch.column("word").to_numpy(), batch.column("near")
        ends, flat = near.offsets.to_numpy(), near.values
        which, n = flat.field("c").to_numpy(), flat.field("n").to_numpy()
        best = np.empty(len(word), np.int64)
        for i, w in enumerate(word):
            counts = np.zeros(2 * k)
            counts[which[ends[i]:ends[i + 1]]] = n[ends[i]:ends[i + 1]]
            after, before, c = counts[:k], counts[k:], own[w]
            left = matrix.copy()
            left[c] -= after
            left[:, c] -= before
            left = np.maximum(left, 0)
            # only transitions to and from the classes next to the word change
            to, fro = np.flatnonzero(after), np.flatnonzero(before)
            gain = (_weighed(left[:, to] + after[to]) - _weighed(left[:, to])).sum(1)
            gain += (_weighed(left[fro] + before[fro, None]) - _weighed(left[fro])).sum(0)
            rows, columns = left.sum(1), left.sum(0)
            gain -= _weighed(rows + after.sum()) - _weighed(rows) + _weighed(columns + before.sum()) - _weighed(columns)
            # words that move at once must not meet in an empty class; the last two classes take nobody in
            gain[rows + columns == 0] = -np.inf
            gain[-2:] = -np.inf
            best[i] = c if gain.max() == -np.inf else int(np.argmax(gain))
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(best)], ["word", "class"])


def exchange(partial: DataFrame, size: int, settings: Settings, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each of the ``size`` + 2 token numbers, and the matrix of class pair counts.

    partial: pair, n (in parts). frequency: tokens of each number, the other words and the end. Distributed exchange: in a round the counts of each word with the classes
    next to it are summed over all pairs, and every word's best class is found by itself against the matrix
    of the round's start. A random half of the words may move in a round, so that words do not change
    places for ever, and the best classes of all rounds count. The pairs are written twice, dealt by their first and by their second word, so that the
    sums of a round shrink before they are shuffled. A word has at most as many pairs as there are numbers
    and at most 2 k sums, however frequent it is. The driver holds the class numbers of the vocabulary
    (bounded by its setting) and the matrix.
    """
    spark, k = partial.sparkSession, settings.classes + 2
    own = np.arange(size + 2) % settings.classes
    own[size], own[size + 1] = k - 2, k - 1
    split = partial.select(F.shiftright("pair", SHIFT).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1)).cast("int").alias("b"), "n")
    # numbers go by frequency, so the hot words are known: each of them makes up to HOT_SHARE of all tokens or more
    hot = [int(i) for i in np.flatnonzero(frequency >= HOT_SHARE * max(1.0, frequency.sum()))]

    def salted(word: str, other: str) -> Column:
        return F.when(F.col(word).isin(hot), F.pmod(F.xxhash64(other), F.lit(HOT_PARTS))).otherwise(0)

    by_first = settle(split.withColumn("salt", salted("a", "b")).repartition("a", "salt").groupBy("a", "salt", "b").agg(F.sum("n").alias("n")).drop("salt"))
    by_second = settle(by_first.withColumn("salt", salted("b", "a")).repartition("b", "salt").sortWithinPartitions("b").drop("salt"))

    def table(columns: str) -> DataFrame:
        frame = spark.createDataFrame(pa.table({"w": pa.array(np.arange(size + 2), pa.int32()), "c": pa.array(own, pa.int32())}))
        return F.broadcast(frame.toDF(*columns.split()))

    def class_pairs() -> np.ndarray:
        matrix = np.zeros((k, k))
        both = by_first.join(table("a ca"), "a").join(table("b cb"), "b").groupBy("ca", "cb").agg(F.sum("n").alias("n"))
        for row in both.collect():  # k * k rows at most
            matrix[row["ca"], row["cb"]] = row["n"]
        return matrix

    best: tuple[float, np.ndarray, np.ndarray] | None = None
    reached: list[float] = []
    for turn in range(settings.rounds + 1):
        matrix = class_pairs()
        value = float(_weighed(matrix).sum() - _weighed(matrix.sum(0)).sum() - _weighed(matrix.sum(1)).sum())
        if best is None or value > best[0]:
            best = value, own.copy(), matrix
        reached.append(best[0])
        if turn == settings.rounds or turn >= 2 and reached[-1] - reached[-3] <= SMALL * (reached[-1] - reached[0]):
            break
        moves = lambda word: (F.col(word) < size) & (F.pmod(F.xxhash64(word) + turn, F.lit(2)) == 0)
        after = by_first.filter(moves("a")).join(table("b c"), "b").groupBy(F.col("a").alias("word"), "c").agg(F.sum("n").alias("n"))
        before = by_second.filter(moves("b")).join(table("a c"), "a").groupBy(F.col("b").alias("word"), (F.col("c") + k).alias("c")).agg(F.sum("n").alias("n"))
        near = after.union(before).groupBy("word").agg(F.collect_list(F.struct("c", "n")).alias("near"))
        moved = near.mapInArrow(lambda batches, o=own.copy(), m=matrix: _exchanged(batches, o, m), "word int, class long").toArrow()
        own[moved.column("word").to_numpy()] = moved.column("class").to_numpy()
    return best[1], best[2]


def _scored(batches: Iterator[pa.RecordBatch], sent: Broadcast) -> Iterator[pa.RecordBatch]:
    """Per text: what the numbered words give, and its other words with their counts."""
    tokens, classes, step, emission, base = sent.value
    numbers = Numbers(tokens)
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for text in encoded(batch.column("text")):
            found = words(text)
            line = np.fromiter(map(numbers.__getitem__, found), np.int64, len(found))
            others = Counter(w for w, n in zip(found, line.tolist()) if n == numbers.other) if (line == numbers.other).any() else {}
            line = np.concatenate([line, [numbers.end]])
            c = classes[line]
            previous = np.concatenate([[classes[numbers.end]], c[:-1]])
            for column, value in zip(out, (
                    len(line), int((line != numbers.other).sum()), float(base[line].sum()),
                    float(step[previous, c].sum() + emission[line].sum()), [{"token": w, "times": t} for w, t in others.items()])):
                column.append(value)
        other = pa.list_(pa.struct([("token", pa.binary()), ("times", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), batch.column("held_out"),
             *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), other)))],
            ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "others"])


def class_scores(docs: DataFrame, held_out, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Tokens are the lower-cased words and one end for each text. The model learns from the rows for which
    ``held_out`` (a column) is not true: P(token | before) = P(class | class before) P(token | class), with

    * transitions: counts of class pairs, with ``prior`` times the class frequencies added (these with one added for each class);
    * emissions: count of the token over that of its class. The class of the other words, which are those outside the vocabulary and
      those that were never seen, adds one to each count and to one unseen word.

    score is the sum of log10 over the text's tokens, base_score that of add-one frequencies of single tokens.
    Counts are exact over all training texts. Words of the vocabulary (bounded) are scored
    from a broadcast table; all other words of a text are joined with their counts by word, with partial counts per text,
    so that what is shuffled is the rare words alone.

    Defined results: NULL is the empty text, whose only token is the end; a NULL held_out counts as not held out; without
    training texts every token is unknown; rows are kept apart however often an id is repeated; an empty table
    gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"),
                       F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    learn = rows.filter(~F.col("held_out"))
    counts = settle(token_counts(learn))
    total, different = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    head = head_of(counts, settings.vocabulary).orderBy(F.col("n").desc(), "token").toArrow()
    tokens, n_head = head.column("token").to_pylist(), head.column("n").to_numpy().astype(np.float64)
    size = len(tokens)
    ends = (counts.filter(F.length("token") == 0).agg(F.sum("n")).first()[0]) or 0
    n_other, different_other = total - ends - n_head.sum(), different - (ends > 0) - size
    shared = spark.sparkContext.broadcast(tokens)
    partial = learn.select("text").mapInArrow(lambda batches: _count_pairs(batches, shared), "pair long, n long")
    classes, matrix = exchange(partial, size, settings, np.concatenate([n_head, [n_other, ends]]))

    frequency = matrix.sum(0) + 1.0
    step = np.log10((matrix + settings.prior * frequency / frequency.sum()) / (matrix.sum(1) + settings.prior)[:, None])
    in_class = np.bincount(classes[:size], n_head, len(matrix))
    emission = np.concatenate([np.log10(n_head / in_class[classes[:size]]), [0.0, 0.0]])
    # the end is alone in its class; other words are added below
    plain = np.log10(total + different + 1)
    base = np.concatenate([np.log10(n_head + 1) - plain, [0.0, np.log10(ends + 1) - plain]])
    sent = spark.sparkContext.broadcast((tokens, classes, step, emission, base))
    schema = (f"row long, doc_id {docs.schema[doc_id].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, base double, "
              "score double, others array<struct<token:binary,times:long>>")
    scored = settle(rows.mapInArrow(lambda batches: _scored(batches, sent), schema))
    rare = scored.select("row", F.inline("others")).join(counts.select(F.col("token").alias("t"), "n"), F.col("token") == F.col("t"), "left")
    c, times = F.coalesce("n", F.lit(0)), F.col("times")
    of_rare = (rare.groupBy("row").agg(
        F.sum(F.when(c > 0, times).otherwise(0)).alias("r_known"), F.sum(times * (F.log10(c + 1) - float(plain))).alias("r_base"),
        F.sum(times * (F.log10(c + 1) - F.log10(F.lit(float(n_other + different_other + 1))))).alias("r_score"))
        .select(F.col("row").alias("r"), "r_known", "r_base", "r_score"))
    zero = F.lit(0)
    # without training texts the end was never seen
    known = F.col("n_known") + F.coalesce("r_known", zero) - (0 if ends else 1)
    return (scored.join(of_rare, F.col("row") == F.col("r"), "left")
            .select("doc_id", "held_out", "n_tokens", known.cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
                    (F.col("base") + F.coalesce("r_base", zero)).alias("base_score"), (F.col("score") + F.coalesce("r_score", zero)).alias("score")))
