"""Mix sources to target weights: whole epochs first, then a weighted sample without replacement."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeledger.llm.common import BLANKS, settle

WEIGHTS, MOST_EPOCHS = (5, 2, 1), 3
#: 52 bits of a hash make the uniform number of a row.
HASH_DIGITS = 13


def words_of(text: Column) -> Column:
    """Whole text as words; NULL has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[^{BLANKS}]+"), F.lit(0))


def variety(words: Column) -> Column:
    """Quality weight of a text, 0.5 to 1.5: the share of its words that are different."""
    return F.lit(0.5) + F.coalesce(F.try_divide(F.size(F.array_distinct(words)), F.size(words)), F.lit(0.0))


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on nothing but the parts."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return (F.conv(F.substring(digest, 1, HASH_DIGITS), 16, 10).cast("double") + 0.5) / float(16 ** HASH_DIGITS)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size, target. sizes: source, source_size, one row for each source.

    Sources, by code point with NULL last, weigh ``weights`` in turn and share the sum of all sizes by
    weight. A target stops at ``most`` times its source's size and the excess is shared by the others,
    which is the same as filling up in order of ``most`` * size / weight: a source is capped if its cap
    per weight is not above the level that is left when all before it are capped.
    """
    one = Window.partitionBy(F.lit(0))
    in_order = F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1
    listed = (sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(in_order, F.lit(len(weights))) + 1))
              .withColumn("cap", F.col("source_size") * most)
              .withColumn("total", F.sum("source_size").over(one)))
    rising = one.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = rising.rowsBetween(Window.unboundedPreceding, -1)
    listed = (listed.withColumn("left_size", F.col("total") - F.coalesce(F.sum("cap").over(earlier), F.lit(0)))
              .withColumn("left_weight", F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))))
    capped = F.col("cap") * F.col("left_weight") <= F.col("left_size") * F.col("weight")
    listed = listed.withColumn("capped", capped)
    # the first source that is not capped has the largest weight left
    level = F.max(F.when(~F.col("capped"), F.struct("left_weight", "left_size"))).over(one)
    shared = F.col("level.left_size") * F.col("weight") / F.col("level.left_weight")
    return (listed.withColumn("level", level)
            .select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(shared).alias("target")))


def limits(rows: DataFrame, buckets: int) -> DataFrame:
    """One row for each source: source_size, target, epochs and where its sample ends (at_slice, last_key).

    rows: source, size, key. A source with target t and size s is taken t // s times as a whole. The rest
    comes from a sample in falling order of ``key`` = u ** (1 / weight), which is the order of exponential
    keys with the documents' weights as rates; it ends where the sum of sizes is nearest to the rest.

    No task sorts a source: sizes are summed by slices of the key, and only the slice in which the sum
    reaches the rest is looked at row by row.
    """
    sliced = rows.withColumn("slice", slice_of(F.col("key"), buckets))
    sums = settle(sliced.groupBy("source", "slice").agg(F.sum("size").alias("slice_size")))
    aims = targets(sums.groupBy("source").agg(F.sum("slice_size").alias("source_size")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    aims = settle(aims.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    same = F.col("source").eqNullSafe(F.col("of"))
    in_order = Window.partitionBy("source").orderBy("slice")
    before = F.col("upto") - F.col("slice_size")
    reached = (sums.withColumn("upto", F.sum("slice_size").over(in_order))
               .join(aims.select(F.col("source").alias("of"), "rest"), same)
               .filter((F.col("upto") >= F.col("rest")) & (before < F.col("rest")))
               .select("of", F.col("slice").alias("at_slice"), before.alias("before"), "rest"))
    # rows with the same key share their fate: they are summed before the last taken key is looked for
    ties = (sliced.join(reached, same & (F.col("slice") == F.col("at_slice"))).groupBy("source", "key")
            .agg(F.sum("size").alias("tied"), F.first("before").alias("before"), F.first("rest").alias("rest")))
    upto = F.col("before") + F.sum("tied").over(Window.partitionBy("source").orderBy(F.col("key").desc()))
    last = (ties.withColumn("upto", upto).filter(2 * F.col("upto") - F.col("tied") < 2 * F.col("rest"))
            .groupBy("source").agg(F.min("key").alias("last_key")).select(F.col("source").alias("of"), "last_key"))
    out = aims.join(reached.select("of", "at_slice"), same, "left").drop("of").join(last, same, "left")
    return settle(out.select(F.col("source").alias("of_source"), "source_size", "target", "epochs", "rest", "at_slice", "last_key"))


def slice_of(key: Column, buckets: int) -> Column:
    return F.least(F.lit(buckets - 1), F.floor((1 - key) * buckets).cast("long"))


def with_copies(rows: DataFrame, bounds: DataFrame, source: Column, key: Column, buckets: int, name: str = "copies") -> DataFrame:
    """Join the limits of its source to each row and add how often the row is taken."""
    place = slice_of(key, buckets)
    # where rounding leaves no slice that reaches the rest, the rest is the whole source
    extra = (F.col("rest") > 0) & (F.col("at_slice").isNull() | (place < F.col("at_slice"))
                                   | (place == F.col("at_slice")) & F.coalesce(key >= F.col("last_key"), F.lit(False)))
    return rows.join(bounds, source.eqNullSafe(F.col("of_source"))).withColumn(name, F.col("epochs") + extra.cast("long"))


def quality_key(doc_id: Column, text: Column, words: Column, seed: int) -> Column:
    """The number by which a source's rows are sampled; it depends on doc_id, text and seed alone."""
    return F.pow(uniform(doc_id, F.md5(text), F.lit(seed)), 1 / variety(words))


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 1) -> DataFrame:
    """doc_id, source, size, key of every row."""
    found = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"),
                        words_of(F.col(text)).alias("words"))
    return found.select("doc_id", "source", F.size("words").cast("long").alias("size"),
                        quality_key(F.col("doc_id"), F.col("text"), F.col("words"), seed).alias("key"))


def slices_for(rows: DataFrame) -> int:
    """The square root of the number of rows: both the slices of a source and the rows of a slice stay few."""
    return max(16, math.isqrt(rows.count()))


def mix_documents(docs: DataFrame, **columns) -> DataFrame:
    """doc_id, source, size, source_size, target, copies for every row of docs.

    Defined results: NULL is a source of its own, after all others; NULL and empty texts have no words and
    are in the sample where their key is; a source without words has target 0 and is not taken; equal rows
    share their fate; an empty table gives an empty result; other columns are not read.
    """
    rows = settle(keyed(docs, **columns))
    buckets = slices_for(rows)
    mixed = with_copies(rows, limits(rows, buckets), F.col("source"), F.col("key"), buckets)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies")


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 1) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; all columns stay as they are.

    The texts are not shuffled: a row is compared with the limits of its source. Defined results as in
    mix_documents().
    """
    rows = settle(keyed(docs, doc_id, text, source, seed))
    buckets = slices_for(rows)
    bounds = limits(rows, buckets)
    renamed = docs.toDF(*[f"own_{i}" for i in range(len(docs.columns))])
    own = {c: F.col(f"own_{i}") for i, c in enumerate(docs.columns)}
    key = quality_key(own[doc_id], own[text], words_of(own[text]), seed)
    kept = with_copies(renamed.withColumn("key", key), bounds, own[source], F.col("key"), buckets).filter("copies > 0")
    copied = kept.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return copied.select(*[column.alias(name) for name, column in own.items()])
