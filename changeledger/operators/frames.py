"""Preparing catalog and ledger frames for the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from changeledger.functions.arrays import add_once
from changeledger.functions.versions import version_key
from changeledger.schema import BAD_SETTING, UNDO_SQL, LedgerError


def item_key() -> Column:
    """Identity of an item: the version's value, or the script when there is none.

    Never NULL, so that joins on it need no null check, which would evaluate the
    key a second time below the join.
    """
    return F.coalesce(F.concat(F.lit("v"), F.col("vsort")),
                      F.concat(F.lit("s"), F.col("script")), F.lit("s"))


def _with_target(df: DataFrame) -> DataFrame:
    """State that every row has a target, as the schema demands.  Joins on it would
    add the same check to one of two uses of an aggregate, and the aggregate would
    then be computed twice instead of once.  ``without_target`` reports the others."""
    return df.filter(F.col("target").isNotNull())


def is_snapshot(ledger: DataFrame) -> bool:
    """Whether this is what ``ledger_snapshot`` gives, one row per item, and not a ledger."""
    return "applied" in ledger.columns


def needs_records(ledger: DataFrame, what: str) -> DataFrame:
    """The ledger; an error for a snapshot, which does not hold every record."""
    if is_snapshot(ledger):
        raise LedgerError(BAD_SETTING, f"{what} needs the ledger itself, not a snapshot of it")
    return ledger


def without_target(*frames: DataFrame) -> DataFrame:
    """A 4002 row for every row of a catalog or ledger that has no target.  A snapshot has none."""
    found = None
    for df in frames:
        if is_snapshot(df):
            continue
        rows = df.filter(F.col("target").isNull()).select(
            F.col("target").cast("string").alias("target"), F.lit(BAD_SETTING).alias("code"),
            F.coalesce("script", F.lit("")).alias("script"), F.lit("a row without a target").alias("detail"))
        found = rows if found is None else found.unionByName(rows)
    return found


def settings(targets: DataFrame, *names: str) -> DataFrame:
    """One row per target with its settings of these names, as far as ``targets`` has them.

    Of several rows for a target the first counts in the order of their values as text, all of one row
    together; ``contradictions`` reports those that differ.
    """
    known = [n for n in names if n in targets.columns]
    if not known:
        return targets.filter(F.col("target").isNotNull()).select("target").distinct()
    row = F.struct(*known)
    return (targets.filter(F.col("target").isNotNull()).groupBy("target")
            .agg(F.min_by(row, F.to_json(row)).alias("row")).select("target", "row.*"))


def contradictions(targets: DataFrame) -> DataFrame:
    """A 4002 row for every target whose rows of settings differ."""
    values = F.to_json(F.struct(*[c for c in targets.columns if c != "target"], F.lit(0).alias("any")))
    found = targets.groupBy("target").agg(F.min(values).alias("first"), F.max(values).alias("last")).filter("first <> last")
    return found.select("target", F.lit(BAD_SETTING).alias("code"), F.lit("").alias("script"),
                        F.lit("settings that contradict each other").alias("detail"))


def _with_missing(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return add_once(df, {n: c for n, c in columns.items() if n not in df.columns})


def prepare_catalog(catalog: DataFrame) -> DataFrame:
    """Add the derived columns a stored catalog may lack.

    Needs target, script, kind, version, description, checksum.  ``vsort`` and
    ``dir_vsort`` that are already stored are used as they are.
    """
    df = _with_target(catalog)
    if "dir_version" not in df.columns:
        df = df.withColumn("dir_version", F.lit(None).cast("string"))
    df = _with_missing(df, {"vsort": version_key(F.col("version")),
                            "dir_vsort": version_key(F.col("dir_version"))})
    return df if "item_key" in df.columns else df.withColumn("item_key", item_key())


def prepare_ledger(ledger: DataFrame) -> DataFrame:
    """Read an empty version as none and add ``vsort`` and ``item_key``."""
    df = _with_target(ledger).withColumn("version", F.nullif(F.col("version"), F.lit("")))
    df = _with_missing(df, {"vsort": version_key(F.col("version"))})
    return df if "item_key" in df.columns else df.withColumn("item_key", item_key())


def executable(catalog: DataFrame) -> DataFrame:
    """The catalog without undo scripts."""
    return catalog.filter(F.col("kind") != UNDO_SQL)


def run_order(by_directory: bool = False) -> Column:
    """Key of the run order: versioned items by [directory version,] version and
    script, then repeatables by description and script."""
    repeatable = F.col("vsort").isNull()
    directory = F.coalesce(F.col("dir_vsort"), F.lit("")) if by_directory else F.lit("")
    return F.struct(
        repeatable.alias("repeatable"),
        directory.alias("directory"),
        F.coalesce(F.col("vsort"), F.lit("")).alias("version"),
        F.when(repeatable, F.coalesce(F.col("description"), F.lit(""))).otherwise("")
        .alias("description"),
        F.col("script").alias("script"))
