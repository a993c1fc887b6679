"""Embedding near-duplicates by spherical-cap filters with structured random product codes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeledger.llm.common import groups, in_blocks, release, settle
from changeledger.llm.components import components

#: Independently rotated codes, parts of a code, vectors of a filter on average.
CODES, PARTS, PER_FILTER = 8, 2, 32
#: Filters per vector that are tried until few enough pairs share none, and how many may: pairs at the least
#: cosine itself, closer ones miss each other far less often.
PER_VECTOR, MISS, PAIRS_TRIED = (8, 12, 16, 24, 32, 48, 64, 96, 128), 0.002, 4_000
#: Vectors of a block that are compared at a time.
BLOCK = 1_024


class Codes:
    """Filter directions: in each of several rotations, one code word from each part, side by side, scaled to length 1.

    With ``size`` code words in each of ``parts`` parts a rotation has size ** parts directions, of which only
    those that a vector exceeds are looked at. The threshold is the one that a random vector exceeds for
    ``per_vector`` directions on average, taken from scores of the code itself; a vector exceeds at least its
    best direction of each rotation. As rotations are random, what holds for random vectors holds for any
    vector, and whether two vectors share a filter depends on their angle alone.
    """

    def __init__(self, dimension: int, vectors: int, per_vector: int, seed: int = 11):
        random = np.random.default_rng(seed)
        self.parts, self.codes = min(PARTS, dimension), CODES
        directions = max(4.0 * per_vector, vectors * per_vector / PER_FILTER)
        self.size = max(2, math.ceil((directions / self.codes) ** (1 / self.parts)))
        self.columns = np.array_split(np.arange(dimension), self.parts)
        self.rotations, self.words = [], []
        for _ in range(self.codes):
            self.rotations.append(np.linalg.qr(random.normal(size=(dimension, dimension)))[0])
            words = [random.normal(size=(self.size, len(c))) for c in self.columns]
            self.words.append([w / np.linalg.norm(w, axis=1, keepdims=True) for w in words])
        self.threshold = self._fitted(random.normal(size=(512, dimension)), per_vector / self.codes)

    @classmethod
    def fitted(cls, dimension: int, vectors: int, least: float) -> Codes:
        """The code with the fewest filters per vector by which few enough pairs at cosine ``least`` miss each other."""
        random = np.random.default_rng(5)
        a = _units(random.normal(size=(PAIRS_TRIED, dimension)))
        b = a
        if dimension > 1 and least < 1:
            across = random.normal(size=a.shape)
            across = _units(across - (across * a).sum(1, keepdims=True) * a)
            b = least * a + math.sqrt(1 - least * least) * across
        for per_vector in PER_VECTOR:
            codes = cls(dimension, vectors, per_vector)
            if codes.missed(a, b) <= MISS:
                break
        return codes

    def _scores(self, code: int, units: np.ndarray) -> list[np.ndarray]:
        turned = units @ self.rotations[code]
        return [turned[:, c] @ w.T for c, w in zip(self.columns, self.words[code])]

    def _fitted(self, sample: np.ndarray, wanted: float) -> float:
        first, *rest = self._scores(0, _units(sample))
        last = np.sort(rest[0], 1) if rest else np.zeros((len(first), 1))
        low, high = -2.0, 2.0
        for _ in range(40):
            middle = (low + high) / 2
            met = sum(last.shape[1] * first.shape[1] - np.searchsorted(of_last, middle - of_first).sum() for of_first, of_last in zip(first, last))
            low, high = (middle, high) if met > wanted * len(first) else (low, middle)
        return high

    def missed(self, a: np.ndarray, b: np.ndarray) -> float:
        """Share of the pairs (a[i], b[i]) that share no filter."""
        one, two = ((row * (self.codes * self.size ** self.parts) + number) for row, number in (self.decode(a), self.decode(b)))
        return 1 - len(np.unique(np.intersect1d(one, two, assume_unique=True) // (self.codes * self.size ** self.parts))) / len(a)

    def decode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, filter) for every direction that exceeds the threshold, and each vector's best one of each rotation.

        Part by part: a prefix of code words is kept if the best of the remaining parts can still lift it.
        """
        rows, numbers = [], []
        for code in range(self.codes):
            scores = self._scores(code, units)
            best = [s.max(1) for s in scores]
            rest = [sum(best[i + 1:], np.zeros(len(units))) for i in range(self.parts)]
            needed = np.minimum(self.threshold, sum(best) - 1e-12)
            row, number, score = np.arange(len(units)), np.zeros(len(units), np.int64), np.zeros(len(units))
            for part, own in enumerate(scores):
                found = []
                for start in range(0, len(row), 4_096):
                    r = row[start:start + 4_096]
                    total = score[start:start + 4_096, None] + own[r]
                    at, word = np.nonzero(total >= (needed - rest[part])[r][:, None])
                    found.append((r[at], number[start:start + 4_096][at] * self.size + word, total[at, word]))
                row, number, score = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3
            rows.append(row)
            numbers.append(code * self.size ** self.parts + number)
        return np.concatenate(rows), np.concatenate(numbers)


def _matrix(values: pa.Array) -> np.ndarray:
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(values), -1).astype(np.float64) if len(values) else np.empty((0, 0))


def _units(values: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled by their largest component first, so that no square leaves the range."""
    values = values / np.abs(values).max(1, keepdims=True)
    return values / np.sqrt((values * values).sum(1, keepdims=True))


def _rounded(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors in bytes, the scale of each, and how far each then is from itself."""
    scale = np.abs(units).max(1, keepdims=True) / 127
    rounded = np.rint(units / scale).astype(np.int8)
    off = np.sqrt(((units - rounded * scale) ** 2).sum(1))
    return rounded, scale[:, 0], off


def _sketched(batches: Iterator[pa.RecordBatch], codes: Codes) -> Iterator[pa.RecordBatch]:
    """filter, id and the vector in bytes, for every filter of the vector."""
    for batch in batches:
        for start in range(0, batch.num_rows, 1_000):
            part = batch.slice(start, 1_000)
            units = _units(_matrix(part.column("embedding")))
            row, number = codes.decode(units)
            rounded, scale, off = _rounded(units)
            sketches = pa.array([r.tobytes() for r in rounded], pa.binary())
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(number), part.column("id").take(at), sketches.take(at), pa.array(scale[row]), pa.array(off[row])],
                ["filter", "id", "sketch", "scale", "off"])


def _pair_sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of the two blocks of a sub-group, and whether they are one block."""
    own = group.column("own").to_numpy()
    lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
    left = np.flatnonzero(own == lo)
    return left, left if lo == hi else np.flatnonzero(own == hi), lo == hi


def _maybe_linked(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Ids of vectors that may be linked to another one of their sub-group: none that is linked is left out.

    By the triangle inequality the product of two rounded vectors differs from the cosine by no more than
    the distances that rounding moved them.
    """
    for group in groups(batches, ["filter", "lo", "hi"]):
        if group.num_rows < 2:
            continue
        left, right, one = _pair_sides(group)
        if not len(left) or not len(right):
            continue
        flat = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.int8).reshape(group.num_rows, -1)
        scale, off = group.column("scale").to_numpy(), group.column("off").to_numpy()
        about = flat.astype(np.float64) * scale[:, None]
        near = about[left] @ about[right].T >= least - 1e-9 - off[left][:, None] - (1 + off[left][:, None]) * off[right][None, :]
        if one:
            np.fill_diagonal(near, False)
        met = np.union1d(left[near.any(1)], right[near.any(0)])
        if len(met):
            yield pa.RecordBatch.from_arrays([group.column("id").combine_chunks().take(pa.array(met))], ["id"])


def _filtered(batches: Iterator[pa.RecordBatch], codes: Codes) -> Iterator[pa.RecordBatch]:
    """filter, id, copies, embedding and the sorted list of all filters of the vector."""
    for batch in batches:
        for start in range(0, batch.num_rows, 1_000):
            part = batch.slice(start, 1_000)
            row, number = codes.decode(_units(_matrix(part.column("embedding"))))
            order = np.lexsort((number, row))
            row, number = row[order], number[order]
            ends = np.searchsorted(row, np.arange(part.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(number)).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [pa.array(number), *(part.column(c).take(pa.array(row)) for c in ("id", "copies", "embedding")), lists],
                ["filter", "id", "copies", "embedding", "filters"])


def _first_meeting(lists: list[np.ndarray], a: np.ndarray, b: np.ndarray, number: int) -> np.ndarray:
    """Whether this filter is the smallest that both vectors of a pair have: a pair counts in one filter only.

    A matrix of linked vectors and smaller filters that two of them have; its product with itself counts
    what they share.
    """
    linked = np.unique(np.concatenate([a, b]))
    smaller = [f[f < number] for f in (lists[i] for i in linked)]
    found, times = np.unique(np.concatenate(smaller), return_counts=True)
    found = found[times > 1]
    if not len(found):
        return np.ones(len(a), bool)
    has = np.zeros((len(linked), len(found)), np.float32)
    for i, own in enumerate(smaller):
        has[i, np.searchsorted(found, own[np.isin(own, found, assume_unique=True)])] = 1
    return (has @ has.T)[np.searchsorted(linked, a), np.searchsorted(linked, b)] == 0


def _linked(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """For each vector of a sub-group: how many vectors it is linked to there, and the smallest linked id.

    The smallest ids join the same vectors as all links would: the labels of a sub-group spread along its
    links until none changes.
    """
    for group in groups(batches, ["filter", "lo", "hi"]):
        if group.num_rows < 2:
            continue
        ids, copies = (group.column(c).to_numpy() for c in ("id", "copies"))
        number = group.column("filter")[0].as_py()
        units = _units(_matrix(group.column("embedding").combine_chunks()))
        left, right, one = _pair_sides(group)
        if not len(left) or not len(right):
            continue
        near = units[left] @ units[right].T >= least
        if one:
            near &= np.triu(np.ones(near.shape, bool), 1)
        a, b = np.nonzero(near)
        if not len(a):
            continue
        a, b = left[a], right[b]
        held = group.column("filters").combine_chunks()
        ends, flat = held.offsets.to_numpy(), held.values.to_numpy()
        fresh = _first_meeting([flat[x:y] for x, y in zip(ends, ends[1:])], a, b, number)
        a, b = a[fresh], b[fresh]
        if not len(a):
            continue
        n = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
        label = ids.copy()
        while True:
            old = label.copy()
            np.minimum.at(label, a, label[b])
            np.minimum.at(label, b, label[a])
            if (old == label).all():
                break
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(ids[met]), pa.array(n[met].astype(np.int64)), pa.array(label[met])], ["id", "n", "label"])


def near_vectors(vectors: DataFrame, least: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Equal vectors are compared once, with their number of copies. Each vector meets others in the filters
    whose direction it exceeds. First only ids and vectors in bytes meet, which tells who may have a link at
    all; these vectors then meet whole, pairs are verified by cosine in double precision and counted in the
    smallest filter they share. The number of filters grows with the number of vectors, so filters keep
    their size; filters with more are cut into blocks. Counts and labels leave a block, never pairs.

    Recall: the number of filters per vector is the first at which at most ``MISS`` of simulated pairs at cosine
    ``least`` itself share no filter, whatever the number of vectors; closer pairs miss each other far less.
    Tests measure it against brute force. No false links.

    Defined results: vectors that are NULL, empty, zero, or with NULL or non-finite components link with
    nothing; vectors of different lengths do not link; equal rows link with each other; a row without links
    has component_id = vec_id; NULL ids are not the smallest of a component; an empty table gives an empty
    result; other columns are not read.
    """
    spark = vectors.sparkSession
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = settle(vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding")).withColumn("usable", F.coalesce(finite, F.lit(False)))
                  .withColumn("embedding", F.when(F.col("usable"), F.transform(x, lambda v: v.cast("double") + 0.0))))
    usable = rows.filter("usable")
    # equal vectors: one representative each, found by value; -0.0 was made 0.0
    of_key = usable.withColumn("key", F.sha2(F.to_json(F.struct("embedding")), 256))
    distinct = settle(of_key.groupBy("key").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
                      .withColumn("id", F.monotonically_increasing_id()))
    found, spent = None, []
    key = ["filter", "lo", "hi"]
    # lengths: one run each; a table has one, or very few
    for row in distinct.groupBy(F.size("embedding").alias("dimension")).count().collect():
        codes = Codes.fitted(row["dimension"], row["count"], least)
        one = distinct.filter(F.size("embedding") == row["dimension"]).select("id", "copies", "embedding")
        sketched = settle(one.mapInArrow(lambda batches, c=codes: _sketched(batches, c), "filter long, id long, sketch binary, scale double, off double"))
        dealt = in_blocks(sketched, ["filter"], "id", BLOCK).repartition(*key).sortWithinPartitions(*key)
        maybe = settle(dealt.mapInArrow(lambda batches: _maybe_linked(batches, least), "id long").distinct())
        release(spark, sketched)
        some = one.join(maybe.withColumnRenamed("id", "maybe_id"), F.col("id") == F.col("maybe_id")).drop("maybe_id")
        spread = settle(some.mapInArrow(lambda batches, c=codes: _filtered(batches, c),
                                        "filter long, id long, copies long, embedding array<double>, filters array<long>"))
        dealt = in_blocks(spread, ["filter"], "id", BLOCK).repartition(*key).sortWithinPartitions(*key)
        met = dealt.mapInArrow(lambda batches: _linked(batches, least), "id long, n long, label long")
        found, spent = met if found is None else found.union(met), [*spent, maybe, spread]
    if found is None:
        found = spark.createDataFrame([], "id long, n long, label long")
    found = settle(found)
    for frame in spent:
        release(spark, frame)
    sums = found.groupBy("id").agg(F.sum("n").alias("others")).select(F.col("id").alias("s_id"), "others")
    linked = components(found.filter("id <> label").select(F.col("id").alias("a"), F.col("label").alias("b")))
    placed = (distinct.select("id", "key", "least", "copies")
              .join(sums, F.col("id") == F.col("s_id"), "left")
              .join(linked, F.col("id") == F.col("node"), "left")
              .select("id", "key", "least", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n"),
                      F.coalesce("component", "id").alias("component")))
    placed = settle(placed)
    named = placed.groupBy("component").agg(F.min("least").alias("smallest")).select(F.col("component").alias("c"), "smallest")
    by_key = (placed.join(named, F.col("component") == F.col("c"))
              .select(F.col("key").alias("of_key"), "n", "smallest"))
    return (rows.withColumn("key", F.when(F.col("usable"), F.sha2(F.to_json(F.struct("embedding")), 256)))
            .join(by_key, F.col("key") == F.col("of_key"), "left")
            .select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("smallest", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
