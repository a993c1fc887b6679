"""SimHash near-duplicates: per-segment bit counts, a grid range join under Manhattan distance, exact check."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeledger.llm.common import groups, in_blocks, settle, unused
from changeledger.llm.components import components
from changeledger.llm.texts import encoded, words

SEED = 42
#: Shingles whose bits are unpacked at a time, and rows of a block of fingerprints that are compared at a time.
SPAN, BLOCK = 32_768, 1_024
#: 64 bits as 32 segments of two bits, in halves of 16 segments: at most one difference in one of the halves
#: if there are at most three in all.
SEGMENTS, PARTS, LOW_BITS, HALF = 16, 2, 0x55555555, 0xFFFFFFFF


def fingerprint_of(text: bytes, length: int = 3) -> int:
    """Majority of the bits of the XXH64 of all word shingles, repeats included; 0 for a text without words."""
    found = words(text)
    if not found:
        return 0
    shingles = map(b" ".join, zip(*(found[i:] for i in range(length)))) if len(found) >= length else iter([b" ".join(found)])
    n = max(1, len(found) - length + 1)
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for start in range(0, n, SPAN):
        part = hashes[start:start + SPAN]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(text: Column, length: int = 3) -> Column:
    """64-bit fingerprint (long, as signed) of a whole text of any length; NULL is the empty text."""
    @F.arrow_udf("long")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([fingerprint_of(t, length) for t in encoded(batch)], pa.int64())

    return made(text)


def cells(prints: DataFrame) -> DataFrame:
    """part, cell, probe, fp: the grid cell of each half of a fingerprint, and the cells one step above it.

    A two-bit segment x has x - (x >> 1) ones, so one subtraction counts all segments: a cell is 16 counts
    of 0 to 2, two bits each. Bit counts that differ in all by d (Manhattan) need at least d different
    bits, so fingerprints within 3 bits have in one half counts within distance 1: the same cell, or
    cells one step apart along one axis. Each side of such a step is found from the lower one.
    """
    bits = [F.shiftrightunsigned("fp", 32 * p).bitwiseAND(F.lit(HALF)) for p in range(PARTS)]
    halves = F.array(*[half - F.shiftrightunsigned(half, 1).bitwiseAND(F.lit(LOW_BITS)) for half in bits])
    held = prints.select("fp", F.posexplode(halves).alias("part", "base"))
    steps = F.array(F.lit(0).cast("long"), *[
        F.when(F.shiftright("base", 2 * i).bitwiseAND(F.lit(3)) < 2, F.lit(1 << 2 * i).cast("long")) for i in range(SEGMENTS)])
    return (held.withColumn("step", F.explode(steps)).filter("step IS NOT NULL")
            .select("part", (F.col("base") + F.col("step")).alias("cell"), (F.col("step") != 0).alias("probe"), "fp"))


def _forest(left: np.ndarray, right: np.ndarray, same: bool, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join whatever is within ``most`` bits, one for each row at most: labels spread until none changes."""
    # as unsigned numbers: of a negative one, the bits of its absolute value would be counted
    near = np.bitwise_count(left.view(np.uint64)[:, None] ^ right.view(np.uint64)[None, :]) <= most
    if same:
        np.fill_diagonal(near, False)
    if not near.any():
        return left[:0], left[:0]
    own, other = left.copy(), right.copy()
    top = np.iinfo(np.int64).max
    while True:
        reached = np.where(near, own[:, None], top).min(0)
        new_other = np.minimum(other, reached)
        new_own = np.minimum(own, np.where(near, new_other[None, :], top).min(1))
        if same:
            new_own = new_other = np.minimum(new_own, new_other)
        if (new_own == own).all() and (new_other == other).all():
            break
        own, other = new_own, new_other
    nodes, labels = np.concatenate([left, right]), np.concatenate([own, other])
    moved = nodes != labels
    return nodes[moved], labels[moved]


def _links(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Links within each sub-group of a cell; a sub-group is two blocks at most."""
    made, total = [], 0

    def flush() -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*made))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for group in groups(batches, ["part", "cell", "lo", "hi"]):
        if group.num_rows < 2:
            continue
        fp, probe, own = (group.column(c).to_numpy() for c in ("fp", "probe", "own"))
        if group.num_rows == 2 and np.bitwise_count((fp[:1] ^ fp[1:]).view(np.uint64)[0]) > most:
            continue
        lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        # rows at home in the cell with each other, and with those that step up into it
        home, first, second = ~probe, own == lo, own == hi
        pairs = [(home & first, home & second, lo == hi), (home & first, probe & second, False)]
        if lo < hi:
            pairs.append((home & second, probe & first, False))
        for left, right, same in pairs:
            if left.any() and right.any():
                a, b = _forest(fp[left], fp[right], same, most)
                if len(a):
                    made.append((a, b))
                    total += len(a)
        if total > 50_000:
            yield flush()
            made, total = [], 0
    if made:
        yield flush()


def near_links(prints: DataFrame, most: int = 3) -> DataFrame:
    """a, b: links between different fingerprints that join whatever is within ``most`` (up to 3) bits.

    prints: fp, each once. The links of a sub-group are a forest, never all its pairs; they join the same
    fingerprints as all pairs would. Cells with one fingerprint are dropped before anything is sorted.
    """
    if most > 3:
        raise ValueError("halves with steps of one find at most 3 different bits")
    rows = cells(prints)
    shared = (rows.groupBy("part", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("probe").alias("no_home")).filter("n > 1 AND NOT no_home")
              .select(F.col("part").alias("p"), F.col("cell").alias("c")))
    kept = settle(rows.join(shared, (F.col("part") == F.col("p")) & (F.col("cell") == F.col("c")), "left_semi"))
    dealt = in_blocks(kept, ["part", "cell"], "fp", BLOCK).select("part", "cell", "lo", "hi", "own", "probe", "fp")
    key = ["part", "cell", "lo", "hi"]
    return (dealt.repartition(*key).sortWithinPartitions(*key)
            .mapInArrow(lambda batches: _links(batches, most), "a long, b long"))


def classes(prints: DataFrame, most: int = 3) -> DataFrame:
    """fp, class: fingerprints with links, and the smallest fingerprint of their component."""
    return settle(components(near_links(prints, most)).select(F.col("node").alias("fp"), F.col("component").alias("class")))


def simhash_groups(docs: DataFrame, length: int = 3, most: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links within ``most`` bits reach) for every row.

    Fingerprints are compared once each, whatever the number of their copies; documents meet them again in
    a join that splits a frequent fingerprint.

    Defined results: texts without words, NULL included, have fingerprint 0 and are linked like others;
    NULL ids are not the smallest unless a component has no other; equal rows are in one component; an
    empty table gives an empty result; other columns are not read.
    """
    rows = settle(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text), length).alias("fp")))
    return rows.join(_named(rows, most), F.col("fp") == F.col("of_fp")).select("doc_id", "fp", "component_id")


def _named(rows: DataFrame, most: int) -> DataFrame:
    """of_fp, class, component_id of every fingerprint."""
    prints = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = classes(prints.select("fp"), most).select(F.col("fp").alias("n"), "class")
    placed = prints.join(linked, F.col("fp") == F.col("n"), "left").withColumn("class", F.coalesce("class", "fp"))
    named = placed.groupBy("class").agg(F.min("least").alias("component_id")).select(F.col("class").alias("k"), "component_id")
    return placed.join(named, F.col("class") == F.col("k")).select(F.col("fp").alias("of_fp"), "class", "component_id")


def one_of_each(docs: DataFrame, length: int = 3, most: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: the row of its smallest doc_id; all columns stay as they are.

    Of several rows with that id the first as written stays. Defined results as in simhash_groups().
    """
    fp, row, kept_row = (unused(docs, c) for c in ("simhash", "row_number", "kept_row"))
    written = settle(docs.withColumn(fp, fingerprints(F.col(text), length)).withColumn(row, F.monotonically_increasing_id()))
    rows = written.select(F.col(doc_id).alias("doc_id"), F.col(fp).alias("fp"), F.col(row).alias("row"))
    first = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    kept = (rows.join(_named(rows, most), F.col("fp") == F.col("of_fp")).groupBy("class").agg(F.min(first).alias("first"))
            .select(F.col("first.row").alias(kept_row)))
    return written.join(kept, F.col(row) == F.col(kept_row), "left_semi").drop(fp, row)
