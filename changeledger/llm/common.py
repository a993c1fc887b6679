"""What several operators of this package share: tables, settled frames, blocks of hot groups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are separated by these characters and no others.
BLANKS = " \\t-\\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lowered(text: Column) -> Column:
    """A-Z become a-z; every other character stays. NULL is the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: what the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; elsewhere it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="changeledger-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def settle(frame: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Later jobs start from the files, so a lost executor costs no recomputation of what came before,
    and values that depend on the place of a row (row numbers) cannot change.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def release(spark: SparkSession, frame: DataFrame) -> None:
    """Delete a settled frame that nothing reads any more."""
    for file in frame.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number all rows from 0 in this order (long), without a task that sees them all. Starts a job.

    Rows are range-partitioned and sorted, and written with their place; the number is the place in the
    partition plus the rows of earlier partitions. What is broadcast is one row per partition. Equal rows
    are dealt out too if ``order`` ends with something that differs between them.
    """
    place, part, shift = (unused(rows, f"{name}_{c}") for c in ("in_part", "part", "shift"))
    placed = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id()))
    of_part = F.shiftright(place, 33)
    parts = placed.groupBy(of_part.alias(part)).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col(part), (F.coalesce(earlier, F.lit(0)) - F.col("first")).alias(shift))
    return (placed.withColumn(part, of_part).join(F.broadcast(parts), part)
            .withColumn(name, F.col(place) + F.col(shift)).drop(place, part, shift))


def unused(frame: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def in_blocks(rows: DataFrame, key: list[str], item: str, limit: int) -> DataFrame:
    """Cut groups of more than ``limit`` rows into pairs of blocks, so that no task gets a whole hot group.

    Adds ``own`` (the row's block), ``lo`` and ``hi``. A group of n blocks becomes the sub-groups
    (lo, hi), 0 <= lo <= hi < n, each with the rows of these two blocks: whoever compares, within a
    sub-group, rows of one block where lo = hi and rows of different blocks where lo < hi, compares every
    pair of the group once. Groups within the limit are the one sub-group (0, 0). The sizes are counted
    with partial sums; only groups over the limit, at most rows / limit of them, are joined to the rows.
    """
    hot = (rows.groupBy(*key).count().filter(F.col("count") > limit)
           .select(*[F.col(k).alias(f"hot_{k}") for k in key], F.ceil(F.col("count") / limit).cast("int").alias("blocks")))
    same = [F.col(k) == F.col(f"hot_{k}") for k in key]
    dealt = (rows.join(hot, same, "left").drop(*[f"hot_{k}" for k in key])
             .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
             .withColumn("own", F.pmod(F.xxhash64(item), F.col("blocks")).cast("int")))
    return (dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
            .drop("blocks", "other"))


def groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """The groups of batches that arrive sorted by ``key``, one table each."""
    import numpy as np

    held: list[pa.Table] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        part = pa.Table.from_batches([batch])
        if held:
            part = pa.concat_tables([*held, part])
        columns = [part.column(k).to_numpy() for k in key]
        changed = np.zeros(part.num_rows - 1, dtype=bool)
        for values in columns:
            changed |= values[1:] != values[:-1]
        starts = [0, *(np.flatnonzero(changed) + 1).tolist()]
        for start, end in zip(starts, starts[1:]):
            yield part.slice(start, end - start)
        held = [part.slice(starts[-1])]
    if held:
        yield held[0]
