"""What a ledger says about each item, in a form that grows by the new records alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from changeledger.operators.frames import prepare_ledger
from changeledger.operators.state import APPLIED_FIELDS
from changeledger.schema import BASELINE

# Each fact is the greatest or smallest of its kind, so facts of parts of a ledger combine to those of all.
SNAPSHOT_COLUMNS = ["target", "item_key", "applied", "last", "last_rank", "done", "done_rank", "failed", "floor",
                    "highest_rank"]


def ledger_snapshot(ledger: DataFrame) -> DataFrame:
    """One row per item of a ledger.

    ``applied``: its latest record; ``last``: the latest but for baselines; ``done``: the latest successful one
    but for baselines; each of these with its rank.  ``failed``: rank and script of the first failed record.
    ``floor``: the highest baseline.  ``highest_rank``: of all records.  State views, validation, plans,
    records, undo and baselines take a snapshot where they take a ledger.  Rows without a target are left out.
    """
    rank, success = F.col("installed_rank"), F.col("success")
    change = F.col("type") != BASELINE
    at, done_at = F.when(change, rank), F.when(change & success, rank)
    return prepare_ledger(ledger).groupBy("target", "item_key").agg(
        F.max_by(F.struct(*APPLIED_FIELDS), rank).alias("applied"),
        F.max_by(F.struct("type", "vsort", "checksum"), at).alias("last"), F.max(at).alias("last_rank"),
        F.max_by(F.struct("type", "version", "vsort"), done_at).alias("done"), F.max(done_at).alias("done_rank"),
        F.min(F.when(~success, F.struct("installed_rank", "script"))).alias("failed"),
        F.max(F.when(~change, F.col("vsort"))).alias("floor"), F.max(rank).alias("highest_rank"))


def merge_snapshots(*snapshots: DataFrame) -> DataFrame:
    """The snapshot of all records together, from snapshots of parts of them in any order."""
    rows = snapshots[0].select(*SNAPSHOT_COLUMNS)
    for snapshot in snapshots[1:]:
        rows = rows.unionByName(snapshot.select(*SNAPSHOT_COLUMNS))

    def latest(fact: str, rank: str) -> Column:
        return F.max_by(fact, rank).alias(fact)

    return rows.groupBy("target", "item_key").agg(
        latest("applied", "applied.installed_rank"),
        latest("last", "last_rank"), F.max("last_rank").alias("last_rank"),
        latest("done", "done_rank"), F.max("done_rank").alias("done_rank"),
        F.min("failed").alias("failed"), F.max("floor").alias("floor"), F.max("highest_rank").alias("highest_rank"))
