"""Statements of planned scripts, and which one failed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from changeledger.functions.placeholders import (
    BUILTIN_NAMESPACE, PREFIX, SUFFIX, substitute, undefined_placeholders)
from changeledger.functions.splitter import Dialect, POSTGRESQL, split_statements
from changeledger.operators.distribute import lookup
from changeledger.operators.frames import settings
from changeledger.schema import EXECUTION_FAILED, PROBLEM_COLUMNS, UNDEFINED_PLACEHOLDER


def _with_values(scripts: DataFrame, targets: DataFrame | None) -> DataFrame:
    """Add the maps ``placeholders`` and ``builtins`` of each target (empty if none)."""
    empty = F.create_map().cast("map<string,string>")
    if targets is not None:
        names = [c for c in ("placeholders", "builtins") if c in targets.columns]
        scripts = lookup(scripts, settings(targets, *names), ["target"], ["script"])
    for name in ("placeholders", "builtins"):
        known = F.col(name) if name in scripts.columns else empty
        scripts = scripts.withColumn(name, F.coalesce(known, empty))
    return scripts


@dataclass(frozen=True)
class Marks:
    """How placeholders are written."""

    prefix: str = PREFIX
    suffix: str = SUFFIX
    namespace: str = BUILTIN_NAMESPACE

    def undefined(self) -> Column:
        return undefined_placeholders(F.col("text"), F.col("placeholders"), F.col("builtins"),
                                      self.prefix, self.suffix, self.namespace)

    def resolved(self) -> Column:
        return substitute(F.col("text"), F.col("placeholders"), F.col("builtins"),
                          self.prefix, self.suffix, self.namespace)


DEFAULT_MARKS = Marks()


def resolve_text(scripts: DataFrame, targets: DataFrame | None = None, marks: Marks = DEFAULT_MARKS,
                 complete_only: bool = False) -> DataFrame:
    """``text`` of target, script rows with the target's values filled in.

    With ``complete_only``, scripts that use an undefined placeholder are left out.
    """
    texts = _with_values(scripts, targets)
    if complete_only:
        texts = texts.filter(F.size(marks.undefined()) == 0)
    return texts.withColumn("text", marks.resolved()).drop("placeholders", "builtins")


def placeholder_problems(scripts: DataFrame, targets: DataFrame | None = None,
                         marks: Marks = DEFAULT_MARKS) -> DataFrame:
    """A 2009 row for every use of a placeholder without a value, with its line."""
    uses = _with_values(scripts, targets).select("target", "script", F.inline(marks.undefined()))
    return uses.select("target", "script", F.lit(UNDEFINED_PLACEHOLDER).alias("code"),
                       F.concat(F.col("key"), F.lit(" in line "), F.col("line").cast("string"))
                       .alias("detail")).select(*PROBLEM_COLUMNS)


def plan_texts(plan: DataFrame, scripts: DataFrame) -> DataFrame:
    """Text of the planned scripts; only these rows of ``scripts`` are carried on."""
    wanted = plan.select("target", "script", "kind", "run_order")
    return scripts.select("target", "script", "text").join(wanted, ["target", "script"])


def missing_texts(plan: DataFrame, scripts: DataFrame) -> DataFrame:
    """A 2010 row for every planned script without a text."""
    known = scripts.filter(F.col("text").isNotNull()).select("target", "script")
    return plan.select("target", "script").join(known, ["target", "script"], "left_anti").select(
        "target", F.lit(EXECUTION_FAILED).alias("code"), "script", F.lit("the script has no text").alias("detail"))


def dry_run(plan: DataFrame, scripts: DataFrame, targets: DataFrame | None = None,
            dialect: Dialect = POSTGRESQL, substitution: bool = True,
            marks: Marks = DEFAULT_MARKS) -> DataFrame:
    """Statements a run would send: target, script, kind, run_order, stmt_no, line, sql.

    A script with an undefined placeholder has none; ``placeholder_problems`` over
    ``plan_texts`` names it.  Sort by target, run_order, stmt_no to read the
    result; nothing here needs the order.
    """
    texts = plan_texts(plan, scripts)
    if substitution:
        texts = resolve_text(texts, targets, marks, complete_only=True)
    return split_statements(texts, dialect)


def write_in_order(statements: DataFrame, path: str) -> None:
    """Write a dry run so that its files, read by name, are the statements in the order they would be sent.

    Rows are dealt out by ranges of (target, run_order, stmt_no) and sorted in each file: no task sorts
    everything, small targets share a file, and a large one is spread over several.
    """
    order = [F.asc("target"), F.asc("run_order"), F.asc("stmt_no")]
    (statements.repartitionByRange(*order).sortWithinPartitions(*order)
     .write.mode("errorifexists").parquet(path))


def failing_statements(statements: DataFrame, outcomes: DataFrame, batch_size: int = 1) -> DataFrame:
    """Number and line of the statement at which each failed script stopped.

    ``outcomes``: target, script, success, batch_no (from 0; with batch size 1 the
    statement's place), applied_in_batch.  In a batch the number follows from how
    many statements were applied, and the line is that of the last statement of
    the batch at most.  ``statements``: target, script, stmt_no, line.
    """
    size = max(batch_size, 1)
    totals = statements.groupBy("target", "script").agg(F.max("stmt_no").alias("total"))
    failed = outcomes.filter(~F.col("success")).join(totals, ["target", "script"])
    start = F.col("batch_no") * size + 1
    applied = F.col("applied_in_batch") if batch_size > 1 else F.lit(0)
    failed = failed.select(
        "target", "script", (start + applied).cast("int").alias("failing_no"),
        F.least(start + applied, start + size - 1, F.col("total")).cast("int").alias("stmt_no"))
    lines = statements.select("target", "script", "stmt_no", "line")
    return failed.join(lines, ["target", "script", "stmt_no"]).select(
        "target", F.lit(EXECUTION_FAILED).alias("code"), "script",
        F.col("failing_no").alias("stmt_no"), "line")
