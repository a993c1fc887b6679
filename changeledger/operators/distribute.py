"""Helpers that keep one hot target from ending up in one task."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from changeledger.schema import BAD_SETTING, LedgerError

# A key with more rows than this is spread over several tasks.  It changes how
# rows are dealt out, never the result.
ROWS_PER_COPY = 1_000_000


def _copies(rows: Column) -> Column:
    return F.ceil(rows / ROWS_PER_COPY).cast("int")


def lookup(rows: DataFrame, facts: DataFrame, on: Sequence[str], spread_by: Sequence[str],
           how: str = "left", weight: str | None = None) -> DataFrame:
    """Join ``rows`` with ``facts`` that have one row per ``on``.

    A key may hold any share of ``rows``.  The fact of such a hot key is repeated
    once per ROWS_PER_COPY rows, and its rows are dealt to the copies by the hash
    of ``spread_by``; all other facts stay single.  ``weight`` names a column of
    ``facts`` with (about) the number of rows of the key, which is used up here;
    without it the rows are counted.

    The broadcast hot keys are at most (number of rows / ROWS_PER_COPY).  The
    join itself is left to the optimizer.
    """
    if weight:
        facts = facts.withColumn("_copies", _copies(F.col(weight))).drop(weight)
        hot = facts.filter("_copies > 1").select(*on, "_copies")
    else:
        hot = (rows.groupBy(*on).agg(_copies(F.count("*")).alias("_copies"))
               .filter("_copies > 1"))
        facts = facts.join(F.broadcast(hot), list(on), "left")
    last_copy = F.coalesce(F.col("_copies"), F.lit(1)) - 1
    copy_of_row = F.pmod(F.xxhash64(*spread_by), last_copy + 1).cast("int")
    dealt = rows.join(F.broadcast(hot), list(on), "left").withColumn("_copy", copy_of_row)
    copied = facts.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.greatest(last_copy, F.lit(0)))))
    return (dealt.drop("_copies").join(copied.drop("_copies"), [*on, "_copy"], how)
            .drop("_copy"))


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Take the folder from spark.checkpoint.dir.

    Executors must share it, so one is made only for a local session without the
    setting; a cluster without it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master != "local" and not context.master.startswith("local["):
            raise LedgerError(BAD_SETTING, "set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="changeledger-"))


def fixed(facts: DataFrame) -> DataFrame:
    """Facts (one row per target) computed once and kept in the checkpoint folder.

    A plan that looks facts up several times would otherwise hold, and may run, all
    that they come from as many times.  Starts a job.
    """
    use_checkpoint_dir(facts.sparkSession)
    return facts.checkpoint()


def number_rows(rows: DataFrame, group: Sequence[str], order: Sequence[Column],
                name: str, total: str | None = None) -> DataFrame:
    """``row_number()`` of each row in its group, without a task per group; with
    ``total``, also the number of rows of the group.

    Rows are range-partitioned by (group, order), so a large group spans several
    partitions.  The result is checkpointed once, which fixes the positions
    against recomputation; a row's number is its place in its partition plus the
    rows of its group in earlier partitions.  ``order`` must be a total order.
    Starts a job.
    """
    use_checkpoint_dir(rows.sparkSession)
    sort_key = [*map(F.col, group), *order]
    placed = (rows.repartitionByRange(*sort_key).sortWithinPartitions(*sort_key)
              .withColumn("_place", F.monotonically_increasing_id())
              .withColumn("_part", F.shiftright("_place", 33))
              .checkpoint())
    parts = placed.groupBy(*group, "_part").agg(
        F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    # One row per group and range partition, never more than there are partitions.
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1
    totals = [F.sum("_rows").over(Window.partitionBy(*group)).cast("int").alias(total)] if total else []
    parts = parts.select(*group, "_part", shift.alias("_shift"), *totals)
    return (placed.join(parts, [*group, "_part"])
            .withColumn(name, (F.col("_place") + F.col("_shift")).cast("int"))
            .drop("_place", "_part", "_shift"))
