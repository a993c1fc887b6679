"""New ledger records and new ledger snapshots."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from changeledger.functions.versions import version_key_of
from changeledger.operators.distribute import lookup, number_rows
from changeledger.operators.frames import (
    contradictions, executable, is_snapshot, needs_records, prepare_catalog, prepare_ledger, settings)
from changeledger.schema import (
    BAD_SETTING, BASELINE, BASELINE_DESCRIPTION, BASELINE_NOT_EMPTY, BASELINE_SCRIPT,
    BASELINE_VERSION, EXECUTION_FAILED, LEDGER_COLUMNS, MISSING_UNDO, PROBLEM_COLUMNS, SQL, UNDO_SQL)

MAX_INT = 2 ** 31 - 1


def _moment(installed_on: datetime | Column | None) -> Column:
    if installed_on is None:
        return F.current_timestamp()
    return F.lit(installed_on) if isinstance(installed_on, datetime) else installed_on


def highest_rank(ledger: DataFrame) -> DataFrame:
    if is_snapshot(ledger):
        return ledger.groupBy("target").agg(F.max("highest_rank").alias("highest_rank"))
    return ledger.groupBy("target").agg(F.max("installed_rank").alias("highest_rank"))


# ------------------------------------------------------------------ baseline

def baseline(targets: DataFrame, ledger: DataFrame, version: str = BASELINE_VERSION,
             installed_by: str = "", installed_on: datetime | Column | None = None
             ) -> tuple[DataFrame, DataFrame]:
    """(records, problems): a baseline record for every target without records,
    and a 2007 row for every other target."""
    version_key_of(version)
    asked = targets.select("target").distinct()
    used = ledger.select("target").distinct()
    records = asked.join(used, "target", "left_anti").select(
        "target", F.lit(1).alias("installed_rank"), F.lit(version).alias("version"),
        F.lit(BASELINE_DESCRIPTION).alias("description"), F.lit(BASELINE).alias("type"),
        F.lit(BASELINE_SCRIPT).alias("script"), F.lit(None).cast("int").alias("checksum"),
        F.lit(installed_by).alias("installed_by"),
        _moment(installed_on).alias("installed_on"),
        F.lit(0).alias("execution_time"), F.lit(True).alias("success"))
    problems = asked.join(used, "target", "left_semi").select(
        "target", F.lit(BASELINE_NOT_EMPTY).alias("code"), F.lit(BASELINE_SCRIPT).alias("script"),
        F.lit("the ledger has records").alias("detail"))
    return records, problems


# -------------------------------------------------------------------- record

def _numbered(plan: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The plan with outcomes (NULL where there is none) and the ``place`` of each item."""
    return number_rows(plan.join(_one_each(outcomes), ["target", "script"], "left"), ["target"],
                       [F.col("run_order")], "place")


def _one_each(outcomes: DataFrame) -> DataFrame:
    """One outcome per script: of several a failed one, then the smallest in the order of the other columns.
    A row without success is no outcome."""
    others = [c for c in outcomes.columns if c not in ("target", "script", "success")]
    return (outcomes.filter(F.col("success").isNotNull()).groupBy("target", "script")
            .agg(F.min(F.struct("success", *others)).alias("one")).select("target", "script", "one.*"))


def _stops(ran: DataFrame) -> DataFrame:
    """Per target: the place of the first item that failed or has no outcome, and the number of items."""
    done = F.coalesce(F.col("success"), F.lit(False))
    return ran.groupBy("target").agg(F.min(F.when(~done, F.col("place"))).alias("stopped_at"),
                                     F.count("*").alias("items"))


def _ran() -> Column:
    """Up to the stop; an item without an outcome did not run."""
    return F.col("success").isNotNull() & (F.col("place") <= F.coalesce("stopped_at", "place"))


def executed(plan: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Planned items that ran, and their ``place``: those up to and including the
    first failure of each target, and before the first item without an outcome.
    Starts a job."""
    ran = _numbered(plan, outcomes)
    return lookup(ran, _stops(ran), ["target"], ["script"], weight="items").filter(_ran()).drop("stopped_at")


def record_problems(plan: DataFrame, outcomes: DataFrame, targets: DataFrame) -> DataFrame:
    """What ``record_outcomes`` cannot take as it is: planned items without an
    outcome (2010, the run of their target stops before them) or with several (2010,
    a failed one counts), planned targets without settings (4002, taken as not
    transactional) or with some that contradict each other (4002)."""
    asked = plan.select("target", "script")
    counts = (outcomes.filter(F.col("success").isNotNull()).groupBy("target", "script")
              .agg(F.count("*").alias("outcomes")))
    odd = asked.join(counts, ["target", "script"], "left").filter("outcomes IS NULL OR outcomes > 1").select(
        "target", F.lit(EXECUTION_FAILED).alias("code"), "script",
        F.when(F.col("outcomes").isNull(), "no outcome")
        .otherwise(F.concat(F.col("outcomes").cast("string"), F.lit(" outcomes"))).alias("detail"))
    planned = asked.select("target").distinct()
    unset = planned.join(targets.select("target"), "target", "left_anti").select(
        "target", F.lit(BAD_SETTING).alias("code"), F.lit("").alias("script"), F.lit("no settings of the target").alias("detail"))
    differ = contradictions(targets).join(planned, "target", "left_semi")
    return odd.unionByName(unset).unionByName(differ)


def record_outcomes(plan: DataFrame, outcomes: DataFrame, targets: DataFrame, ledger: DataFrame,
                    installed_by: str = "", installed_on: datetime | Column | None = None) -> DataFrame:
    """Ledger records of a run, with the next free ranks in run order.

    ``outcomes``: target, script, success, elapsed_ms.  ``targets``: target,
    transactional; a failed item of a transactional target was rolled back and
    leaves no record.  As it is the last of its target, no rank is left free.
    A target without a row there is taken as not transactional; what has no outcome
    did not run; of several outcomes a failed one counts (``record_problems`` reports
    these cases).  Everything about a target is one row, which meets its items in
    one join.  Starts a job.
    """
    ran = _numbered(plan, outcomes)
    known = settings(targets, "transactional")
    if "transactional" not in known.columns:
        known = known.withColumn("transactional", F.lit(False))
    facts = (_stops(ran).join(known, "target", "left")
             .join(highest_rank(ledger), "target", "left"))
    rows = lookup(ran, facts, ["target"], ["script"], weight="items").filter(_ran())
    rows = rows.filter(F.col("success") | ~F.coalesce("transactional", F.lit(False)))
    rank = F.coalesce(F.col("highest_rank"), F.lit(0)) + F.col("place")
    return rows.select(
        "target", rank.alias("installed_rank"), "version", "description",
        F.when(F.col("kind") == UNDO_SQL, UNDO_SQL).otherwise(SQL).alias("type"),
        "script", "checksum", F.lit(installed_by).alias("installed_by"),
        _moment(installed_on).alias("installed_on"),
        F.least(F.col("elapsed_ms"), F.lit(MAX_INT)).cast("int").alias("execution_time"),
        "success")


def version_reached(ledger: DataFrame, plan: DataFrame) -> DataFrame:
    """(target, version): highest version over successful records and planned items."""
    ledger = prepare_ledger(needs_records(ledger, "the version reached"))
    done = ledger.filter(F.col("success") & F.col("vsort").isNotNull()
                         & (F.col("type") != UNDO_SQL))
    both = done.select("target", "version", "vsort", F.lit(1).alias("recorded"),
                       (-F.col("installed_rank")).alias("age")).unionByName(
        plan.filter(F.col("vsort").isNotNull()).select(
            "target", "version", "vsort", F.lit(0).alias("recorded"), F.lit(0).alias("age")))
    return both.groupBy("target").agg(
        F.max_by("version", F.struct("vsort", "recorded", "age")).alias("version"))


# ---------------------------------------------------------------------- undo

def undo_targets(ledger: DataFrame) -> DataFrame:
    """(target, version, vsort): the version an undo would take back."""
    if is_snapshot(ledger):
        latest = ledger.filter("done.vsort IS NOT NULL").select("target", "done.vsort", F.col("done").alias("last"))
    else:
        rows = prepare_ledger(ledger).filter(
            F.col("vsort").isNotNull() & F.col("success") & (F.col("type") != BASELINE))
        latest = rows.groupBy("target", "vsort").agg(
            F.max_by(F.struct("type", "version"), "installed_rank").alias("last"))
    live = latest.filter(F.col("last.type") != UNDO_SQL)
    return live.groupBy("target").agg(
        F.max(F.struct("vsort", "last.version")).alias("top")).select("target", "top.version", "top.vsort")


def undo_plan(targets: DataFrame, catalog: DataFrame, ledger: DataFrame
              ) -> tuple[DataFrame, DataFrame]:
    """(plan, problems): the undo script of each target's latest version; 2008
    where there is no such version or no script for it."""
    fields = ["script", "kind", "version", "vsort", "description", "checksum", "item_key"]
    undo = (prepare_catalog(catalog).filter(F.col("kind") == UNDO_SQL)
            .groupBy("target", "vsort").agg(F.min_by(F.struct(*fields), "script").alias("undo")))
    found = (targets.select("target").distinct()
             .join(undo_targets(ledger).withColumnRenamed("version", "undone_version"),
                   "target", "left")
             .join(undo, ["target", "vsort"], "left"))
    plan = found.filter(F.col("undo").isNotNull()).select(
        "target", "undone_version", F.col("undo.*"),
        F.struct(F.col("undo.script").alias("script")).alias("run_order"))
    problems = found.filter(F.col("undo").isNull()).select(
        "target", F.lit(MISSING_UNDO).alias("code"), F.lit("").alias("script"),
        F.coalesce(F.concat(F.lit("no undo script for version "), F.col("undone_version")),
                   F.lit("nothing to undo")).alias("detail"))
    return plan, problems.select(*PROBLEM_COLUMNS)


# -------------------------------------------------------------------- repair

def checksum_updates(catalog: DataFrame, ledger: DataFrame) -> DataFrame:
    """(target, script, vsort, new_checksum, records) for recorded scripts whose
    latest successful record differs from the catalog; ``records`` is how many
    records the version has."""
    ledger = prepare_ledger(ledger)
    items = executable(prepare_catalog(catalog)).filter(F.col("vsort").isNotNull())
    latest = ledger.filter(F.col("success") & F.col("vsort").isNotNull()
                           & ~F.col("type").isin(UNDO_SQL, BASELINE)) \
        .groupBy("target", "vsort").agg(
            F.max_by(F.struct("script", "checksum"), "installed_rank").alias("last"),
            F.count("*").alias("records"))
    both = items.select("target", "vsort", F.col("checksum").alias("new_checksum")) \
        .join(latest, ["target", "vsort"])
    return both.filter(~F.col("new_checksum").eqNullSafe(F.col("last.checksum"))).select(
        "target", F.col("last.script").alias("script"), "vsort", "new_checksum", "records")


def repaired(ledger: DataFrame, updates: DataFrame) -> DataFrame:
    """The ledger without failed records and with updated checksums; rows without a target as they are."""
    columns = [c for c in LEDGER_COLUMNS if c in ledger.columns]
    more = [c for c in ledger.columns if c not in columns]
    per_script = updates.groupBy("target", "script").agg(
        F.max_by("new_checksum", "vsort").alias("new_checksum"), F.sum("records").alias("records"))
    rows = ledger.select(*columns, *more).filter(F.col("target").isNotNull() & F.col("success"))
    kept = lookup(rows, per_script.withColumn("aligned", F.lit(True)), ["target", "script"], ["installed_rank"], weight="records")
    checksum = F.when(F.col("aligned"), F.col("new_checksum")).otherwise(F.col("checksum"))
    kept = kept.withColumn("checksum", checksum).select(*columns, *more)
    return kept.unionByName(ledger.select(*columns, *more).filter(F.col("target").isNull()))


def repair_report(ledger: DataFrame, updates: DataFrame) -> DataFrame:
    """target, action (removed, aligned, or left: a row without a target), script."""
    action = F.when(F.col("target").isNull(), "left").otherwise("removed")
    return ledger.filter(F.col("target").isNull() | ~F.col("success")).select(
        "target", action.alias("action"), "script").unionByName(
        updates.select("target", F.lit("aligned").alias("action"), "script"))


def repair(catalog: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new ledger, report of target, action, script).

    Failed records are removed.  A version whose checksum differs from the
    catalog gets the catalog's, on all successful records of its script.  All
    other values stay as they are, also those of rows without a target, which
    the report names as left.  The new ledger is a snapshot: write it to a new
    place, or use ``repair_in_place`` on a ledger stored by parts.
    """
    updates = checksum_updates(catalog, needs_records(ledger, "repair"))
    return repaired(ledger, updates), repair_report(ledger, updates)


def repair_counts(report: DataFrame) -> DataFrame:
    return report.filter(F.col("target").isNotNull()).groupBy("target").agg(
        F.count_if(F.col("action") == "removed").alias("removed"),
        F.count_if(F.col("action") == "aligned").alias("aligned"))
