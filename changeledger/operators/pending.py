"""What a run would execute."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from changeledger.functions.selection import VersionSelection
from changeledger.operators.distribute import fixed, lookup, number_rows
from changeledger.operators.frames import executable, is_snapshot, prepare_catalog, prepare_ledger, run_order
from changeledger.schema import (
    BASELINE, FAILED_NEEDS_REPAIR, INVALID_VERSION, OUT_OF_ORDER_CODE, PROBLEM_COLUMNS, UNDO_SQL)

EVERYTHING = VersionSelection()


def failed_gate(ledger: DataFrame) -> DataFrame:
    """(target, script) of the first failed record of each target that has one."""
    if is_snapshot(ledger):
        return ledger.filter("failed IS NOT NULL").groupBy("target").agg(F.min("failed")["script"].alias("script"))
    failed = ledger.filter(F.col("target").isNotNull() & ~F.col("success"))
    return failed.groupBy("target").agg(F.min_by("script", "installed_rank").alias("script"))


def _recorded(ledger: DataFrame) -> DataFrame:
    """Per item: the latest record but for baselines (``last``), whether any failed, and the highest baseline."""
    if is_snapshot(ledger):
        return ledger.select("target", "item_key", "last", F.col("failed").isNotNull().alias("item_failed"),
                             F.col("floor").alias("item_floor"))
    is_baseline = F.col("type") == BASELINE
    return prepare_ledger(ledger).groupBy("target", "item_key").agg(
        F.max_by(F.struct("type", "vsort", "checksum"), F.when(~is_baseline, F.col("installed_rank"))).alias("last"),
        F.bool_or(~F.col("success")).alias("item_failed"),
        F.max(F.when(is_baseline, F.col("vsort"))).alias("item_floor"))


def _target_facts(items: DataFrame, recorded: DataFrame) -> DataFrame:
    """Per target: failed gate, baseline floor, highest applied version, number of items."""
    done = F.when(F.col("last.type") != UNDO_SQL, F.col("last.vsort"))
    parts = recorded.select("target", F.col("item_failed").alias("failed"), F.col("item_floor").alias("floor"),
                            done.alias("highest"), F.lit(None).cast("int").alias("item"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("failed", "boolean"), ("floor", "string"), ("highest", "string"))]
    return parts.unionByName(items.select("target", *none, F.lit(1).alias("item"))).groupBy("target").agg(
        F.bool_or("failed").alias("failed"), F.max("floor").alias("floor"),
        F.max("highest").alias("highest"), F.count("item").alias("items"))


def verdicts(catalog: DataFrame, ledger: DataFrame, selection: VersionSelection = EVERYTHING,
             out_of_order: bool = False, several_uses: bool = False) -> DataFrame:
    """Selected catalog items with a ``verdict``: pending, blocked, out_of_order,
    skip_baseline, skip_applied or skip_unchanged.

    Baseline records set the floor but do not count as applied versions here.
    What is known about targets meets the items in one join.  The ledger is aggregated
    once: the join and the facts about targets use the same rows per item, with all
    of their columns, so that one shuffle serves both.  With ``several_uses`` of the
    result the facts are computed first, in a job of their own.
    """
    items = executable(prepare_catalog(catalog)).filter(selection.predicate())
    recorded = _recorded(ledger)
    facts = _target_facts(items, recorded)
    rows = lookup(items.join(recorded, ["target", "item_key"], "left"),
                  fixed(facts) if several_uses else facts, on=["target"], spread_by=["item_key"],
                  weight="items")

    versioned = F.col("vsort").isNotNull()
    newer = F.col("highest").isNull() | (F.col("vsort") > F.col("highest"))
    unchanged = F.col("checksum").isNull() | F.col("checksum").eqNullSafe(F.col("last.checksum"))
    # an item's own failure or baseline is one of its target's
    failed = F.coalesce("failed", "item_failed") | F.coalesce("item_failed", F.lit(False))
    verdict = (F.when(failed, "blocked")
               .when(versioned & (F.col("vsort") <= F.greatest("floor", "item_floor")), "skip_baseline")
               .when(versioned & (F.col("last.type") != UNDO_SQL), "skip_applied")
               .when(versioned & ~newer & F.lit(not out_of_order), "out_of_order")
               .when(~versioned & F.col("last").isNotNull() & unchanged, "skip_unchanged")
               .otherwise("pending"))
    return rows.withColumn("verdict", verdict).drop("last", "item_failed", "item_floor", "failed", "floor", "highest")


def pending(catalog: DataFrame, ledger: DataFrame, selection: VersionSelection = EVERYTHING,
            out_of_order: bool = False, by_directory: bool = False,
            held: DataFrame | None = None) -> DataFrame:
    """Items to run, with their ``run_order`` key.  A target with a failed record,
    or with an item out of order when that is not allowed, gets none.

    ``held`` (target, items) names more targets that get none, each with the
    number of its items, or about that.
    """
    judged = verdicts(catalog, ledger, selection, out_of_order, several_uses=not out_of_order)
    todo = judged.filter(F.col("verdict") == "pending").drop("verdict")
    if not out_of_order:
        late = judged.groupBy("target").agg(
            F.count_if(F.col("verdict") == "out_of_order").alias("late"),
            F.count("*").alias("items")).filter("late > 0").drop("late")
        held = late if held is None else held.unionByName(late)
    if held is not None:
        held = fixed(held.groupBy("target").agg(F.max("items").alias("items")))
        todo = lookup(todo, held, ["target"], ["item_key"], "left_anti", weight="items")
    return todo.withColumn("run_order", run_order(by_directory))


def pending_problems(catalog: DataFrame, ledger: DataFrame,
                     selection: VersionSelection = EVERYTHING,
                     out_of_order: bool = False, targets: DataFrame | None = None) -> DataFrame:
    """Why targets are held back: failed records (2004), a selection without any
    hit (2001), items out of order (2006).  ``targets``: those that are asked for."""
    failed = failed_gate(ledger).select(
        "target", F.lit(FAILED_NEEDS_REPAIR).alias("code"), "script",
        F.lit("failed record").alias("detail"))
    late = verdicts(catalog, ledger, selection, out_of_order).filter(
        F.col("verdict") == "out_of_order").select(
        "target", F.lit(OUT_OF_ORDER_CODE).alias("code"), "script",
        F.concat(F.lit("version "), F.col("version")).alias("detail"))
    return failed.unionByName(selection_without_hit(catalog, selection, targets)).unionByName(late)


def selection_without_hit(catalog: DataFrame, selection: VersionSelection,
                          targets: DataFrame | None = None) -> DataFrame:
    """A 2001 row per target where an EXACT, FAMILY or REGEX selection finds nothing.

    Targets are all of the catalog, those with undo scripts alone too, and of
    ``targets``, which may have no script at all.
    """
    expected = selection.regex or selection.target or ""
    found = prepare_catalog(catalog)
    asked = found.select("target", (selection.predicate() & (F.col("kind") != UNDO_SQL)).alias("hit"))
    if targets is not None:
        asked = asked.unionByName(targets.select("target", F.lit(False).alias("hit")))
    hits = asked.groupBy("target").agg(F.bool_or("hit").alias("hit"))
    return hits.filter(~F.col("hit") & F.lit(selection.must_hit)).select(
        "target", F.lit(INVALID_VERSION).alias("code"), F.lit("").alias("script"),
        F.lit(f"nothing matches {expected}").alias("detail")).select(*PROBLEM_COLUMNS)


def range_end_warning(catalog: DataFrame, selection: VersionSelection,
                      shown: int = 5, by_directory: bool = False) -> DataFrame:
    """(target, versions, left_out): members of the end version's family that a RANGE
    leaves out - the first few in catalog order, and how many there are."""
    key, raw = selection.key_column, selection.version_column
    cut = executable(prepare_catalog(catalog)).filter(selection.left_out_by_end())
    distinct = cut.withColumn("place", run_order(by_directory)).groupBy("target", key).agg(
        F.min_by(raw, "place").alias("version"), F.min("place").alias("place"))
    counts = distinct.groupBy("target").agg(F.count("*").alias("left_out"))
    # The rank limit is applied before the shuffle as well: few rows per target move.
    place = F.row_number().over(Window.partitionBy("target").orderBy("place"))
    first = (distinct.withColumn("nr", place).filter(F.col("nr") <= shown)
             .groupBy("target").agg(F.array_sort(F.collect_list(F.struct("nr", "version"))).alias("v"))
             .select("target", F.col("v.version").alias("versions")))
    return first.join(counts, "target")


def with_progress(plan: DataFrame) -> DataFrame:
    """Add ``step`` (1, 2, ...) and ``steps`` per target.  Starts a job."""
    return number_rows(plan, ["target"], [F.col("run_order")], "step", total="steps")
