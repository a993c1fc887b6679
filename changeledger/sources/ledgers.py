"""Reading and writing ledgers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from changeledger.operators.frames import prepare_catalog, prepare_ledger
from changeledger.schema import LEDGER_COLUMNS, LEDGER_SCHEMA

_ABSENT = {"PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND"}


def read_ledger(spark: SparkSession, path: str | None = None, table: str | None = None) -> DataFrame:
    """A parquet folder or a table; a ledger that does not exist yet is empty.

    Any other error is raised.  Records are not sorted: operators do not need it.
    """
    try:
        return spark.read.parquet(path) if path else spark.read.table(table)
    except AnalysisException as error:
        if error.getCondition() in _ABSENT:
            return spark.createDataFrame([], LEDGER_SCHEMA)
        raise


def in_rank_order(ledger: DataFrame) -> DataFrame:
    """For display."""
    return ledger.orderBy("target", "installed_rank")


def create_ledger_table(spark: SparkSession, table: str) -> None:
    """Create an empty ledger table; does nothing when it exists."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in LEDGER_SCHEMA)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet")


def append_records(records: DataFrame, path: str | None = None, table: str | None = None) -> None:
    writer = records.select(*LEDGER_COLUMNS).write.mode("append")
    if path:
        writer.parquet(path)
    else:
        writer.insertInto(table)


def write_snapshot(ledger: DataFrame, path: str) -> None:
    """Write a repaired ledger to a new folder; an existing one is left alone."""
    ledger.write.mode("errorifexists").parquet(path)


def save_bucketed(frame: DataFrame, table: str, buckets: int) -> None:
    """Store a prepared catalog or ledger bucketed by (target, item_key).

    Catalog and ledger stored with the same number of buckets meet in
    ``state_view`` and ``verdicts`` without a shuffle of either.
    """
    prepare = prepare_catalog if "kind" in frame.columns else prepare_ledger
    (prepare(frame).withColumn("item_key", F.col("item_key")).write.format("parquet")
     .bucketBy(buckets, "target", "item_key").sortBy("target", "item_key")
     .mode("errorifexists").saveAsTable(table))
