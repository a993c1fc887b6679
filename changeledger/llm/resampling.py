"""Importance resampling towards a target collection, by hashed runs of words."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from changeledger.llm.common import numbered, settle, unused

#: Bytes that may stand in a word once A-Z are a-z: digits, a-z and all bytes of other characters.
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Bytes of texts that are looked at together, and features that are hashed together.
BYTES_AT_ONCE, FEATURES_AT_ONCE = 4 << 20, 1 << 17


class PositionCrc:
    """CRC-32 of many spans of a buffer at once, from a table of what a byte contributes at each distance from the end.

    The code is linear: that of a span is the exclusive or of its bytes' contributions and of a constant of
    its length. Spans longer than the table are cut into blocks that end with the span; the register after
    one block reaches the end of the next as if its four bytes stood at that block's front.
    """

    def __init__(self, reach: int = 32):
        self.reach = max(4, reach)
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
        rows = [step]
        for _ in range(self.reach - 1):
            rows.append((rows[-1] >> 8) ^ step[rows[-1] & 255])
        self.table = np.stack(rows).astype(np.uint32)
        # the register after so many zero bytes, from the start value of all ones
        self.zeros = np.array([zlib.crc32(bytes(n)) ^ 0xFFFFFFFF for n in range(self.reach + 1)], np.uint32)

    def of(self, buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """CRC-32 (unsigned) of each span of at least one byte. Spans may overlap."""
        reach = self.reach
        blocks = (lengths + reach - 1) // reach
        head = lengths - (blocks - 1) * reach
        first = np.cumsum(blocks) - blocks
        sizes = np.full(int(blocks.sum()), reach)
        sizes[first] = head
        ends = np.cumsum(sizes)
        begins = ends - sizes
        # a span's blocks lie behind each other, so its bytes do
        from_span = np.repeat(starts - begins[first], lengths) + np.arange(ends[-1] if len(ends) else 0)
        distance = np.repeat(ends, sizes) - 1 - np.arange(len(from_span))
        parts = np.bitwise_xor.reduceat(self.table[distance, buffer[from_span]], begins) if len(begins) else np.empty(0, np.uint32)
        register = parts[first] ^ self.zeros[head]
        long, table = np.flatnonzero(blocks > 1), self.table
        for block in range(1, int(blocks.max(initial=0))):
            long = long[blocks[long] > block]
            r = register[long]
            register[long] = (table[reach - 1, r & 255] ^ table[reach - 2, r >> 8 & 255] ^ table[reach - 3, r >> 16 & 255]
                              ^ table[reach - 4, r >> 24] ^ parts[first[long] + block])
        return register ^ np.uint32(0xFFFFFFFF)


class Features:
    """Buckets of all runs of 1 to ``longest`` consecutive words, joined by one space."""

    def __init__(self, longest: int, buckets: int):
        self.longest, self.buckets, self.crc = longest, buckets, PositionCrc()

    def of(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]]:
        """For lots of texts: the first text's number, words per text, and (text, bucket) of the features in lots."""
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]) if len(texts) else np.empty(0, np.int64)
        upto, start = np.cumsum(sizes), 0
        while start < len(texts):
            before = upto[start] - sizes[start]
            end = max(start + 1, int(np.searchsorted(upto, before + BYTES_AT_ONCE, "right")))
            lot = texts.slice(start, end - start)
            at = int(np.frombuffer(lot.buffers()[1], np.int64)[lot.offset])
            data = np.frombuffer(lot.buffers()[2], np.uint8, int(upto[end - 1] - before), at) if upto[end - 1] > before else np.empty(0, np.uint8)
            buffer = _LOWER[data]
            begins = (upto - sizes)[start:end] - before
            first, last = self._words(buffer, begins[begins < len(buffer)])
            of_text = np.searchsorted(begins + sizes[start:end], first, "right")
            yield start, np.bincount(of_text, minlength=end - start), self._lots(buffer, first, last, of_text)
            start = end

    @staticmethod
    def _words(buffer: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte of each word, and the byte behind it. No word goes on from one text into the next."""
        inside = _WORD[buffer]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        first[begins] = inside[begins]
        ends = begins[begins > 0] - 1
        last[ends] = inside[ends]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def _lots(self, buffer: np.ndarray, first: np.ndarray, last: np.ndarray, of_text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for start in range(0, len(first), FEATURES_AT_ONCE):
            own = slice(start, start + FEATURES_AT_ONCE)
            reach = slice(start, start + FEATURES_AT_ONCE + self.longest - 1)
            sizes, text = last[reach] - first[reach], of_text[reach]
            # the words with one space behind each
            ends = np.cumsum(sizes + 1) - 1
            packed = np.full(ends[-1] + 1, 0x20, np.uint8)
            word = np.repeat(np.arange(len(sizes)), sizes)
            within = np.arange(len(word))
            packed[within + word] = buffer[np.repeat(first[reach] - (np.cumsum(sizes) - sizes), sizes) + within]
            n = len(first[own])
            for run in range(self.longest):
                i = np.arange(min(n, len(sizes) - run))
                i = i[text[i] == text[i + run]]
                if len(i):
                    begin = ends[i] - sizes[i]
                    yield text[i], self.crc.of(packed, begin, ends[i + run] - begin) % self.buckets


def bucket_counts(texts: DataFrame, text: str, longest: int, buckets: int) -> DataFrame:
    """bucket, n of all features of a table: each task sends one row per bucket at most."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, counts = Features(longest, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, lots in features.of(batch.column(0)):
                for _, bucket in lots:
                    counts += np.bincount(bucket, minlength=buckets)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int64)), pa.array(counts[met])], ["bucket", "n"])

    return texts.select(F.col(text).alias("text")).mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str, longest: int, buckets: int) -> list[int]:
    """For each bucket floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))). ``buckets`` numbers come to the driver."""
    sides = bucket_counts(docs, text, longest, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    sides = sides.union(bucket_counts(target, text, longest, buckets).select("bucket", F.lit(0).cast("long"), "n"))
    every = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    one = settle(every.union(sides).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    total = one.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    all_s, all_t = (F.lit(float(total[c] + buckets)) for c in ("s", "t"))
    double = lambda c: F.col(c).cast("double")
    ratio = ((double("t") + 1) * all_s) / ((double("s") + 1) * all_t)
    rows = one.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect()
    found = [0] * buckets
    for row in rows:
        found[row["bucket"]] = row["gain"]
    return found


def feature_sums(text: Column, gain: list[int], longest: int) -> Column:
    """Struct of n_words, n_features and the sum of the features' gains."""
    table, schema = np.array(gain, np.int64), "struct<n_words: long, n_features: long, gain: long>"

    @F.arrow_udf(schema)
    def summed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        features = Features(longest, len(table))
        for batch in batches:
            words, n, sums = (np.zeros(len(batch), np.int64) for _ in range(3))
            for start, counts, lots in features.of(batch):
                words[start:start + len(counts)] = counts
                for of_text, bucket in lots:
                    # in whole numbers: sums of doubles would round
                    cuts = np.flatnonzero(np.diff(of_text, prepend=-1))
                    met = start + of_text[cuts]
                    n[met] += np.diff(np.append(cuts, len(of_text)))
                    sums[met] += np.add.reduceat(table[bucket], cuts)
            yield pa.StructArray.from_arrays([pa.array(words), pa.array(n), pa.array(sums)], ["n_words", "n_features", "gain"])

    return summed(text)


def importance(docs: DataFrame, target: DataFrame, *, longest: int = 1, buckets: int = 10_000, seed: int = 2024,
               percent: int = 10, least_words: int = 20, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Every row of docs (its columns ``keep``, all by default) with n_words, n_features, weight, score and rank (long).

    Features are the runs of 1 to ``longest`` words of a text, hashed into ``buckets``. ``weight`` is the
    floored mean over a text's features of how much commoner their bucket is in ``target`` than in ``docs``;
    ``score`` adds Gumbel noise from doc_id and ``seed``, so that the highest scores are a draw without
    replacement by weight. Of the N rows with at least ``least_words`` words the floor(percent * N / 100)
    highest scores are drawn and ranked 1, 2, 3...; ``rank`` of the others is NULL.

    Counts are sums per task and bucket. Rows are ranked by a range-partitioned sort of the rows at or above the
    score at which the draw ends. Scores are whole numbers within some tens of thousands at any table size,
    so the table of rows per score is small.

    Defined results: NULL and empty texts have no words, weight 0; a NULL doc_id is the empty one; ties go to the
    smaller doc_id (NULL first), then to fewer features and the smaller weight; repeated rows are each a row
    of their own; an empty ``docs`` gives an empty result; an empty ``target`` gives weights from smoothing
    alone. A new column whose name ``docs`` already has gets an underscore behind it.
    """
    gain = gains(docs, target, text, longest, buckets)
    kept = docs.columns if keep is None else keep
    sums = feature_sums(F.col("text"), gain, longest)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = (docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
            .select("row", "doc_id", sums.alias("sums")).select("row", "doc_id", "sums.*")
            .withColumn("weight", F.when(F.col("n_features") > 0, F.expr("gain div n_features - int(pmod(gain, n_features) <> 0 AND gain < 0)")).otherwise(0).cast("long"))
            .withColumn("score", F.col("weight") + noise))
    rows = settle(rows.drop("gain"))
    able = F.col("n_words") >= least_words
    per_score = rows.filter(able).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.desc("score")))
    draw = F.floor(F.sum("n").over(Window.partitionBy()) * percent / 100)
    edge = per_score.select("score", upto.alias("upto"), draw.alias("draw")).filter("upto >= draw").orderBy(F.desc("score")).first()
    if edge is None or edge["draw"] == 0:
        ranked = rows.withColumn("rank", F.lit(None).cast("long"))
    else:
        high = able & (F.col("score") >= edge["score"])
        order = [F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("weight"), F.monotonically_increasing_id()]
        drawn = numbered(rows.filter(high).withColumn("tie", F.monotonically_increasing_id()), [*order[:-1], F.col("tie")], "place_").drop("tie")
        drawn = drawn.withColumn("rank", F.when(F.col("place_") < edge["draw"], F.col("place_") + 1)).drop("place_")
        ranked = rows.filter(~high).withColumn("rank", F.lit(None).cast("long")).unionByName(drawn)
    plain = docs.select(*[F.col(f"`{c}`") for c in kept])
    return ranked.select("row.*", *[F.col(c).cast("long").alias(unused(plain, c)) for c in ("n_words", "n_features", "weight", "score", "rank")])


def resampled(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The drawn rows of docs, with the columns they came with. Settings and defined results: see ``importance``."""
    scored = importance(docs, target, **settings)
    return scored.filter(F.col(f"`{scored.columns[-1]}`").isNotNull()).select(*[F.col(f"`{c}`") for c in docs.columns])
