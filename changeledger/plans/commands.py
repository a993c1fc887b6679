"""The commands over one catalog and one ledger frame.

Every method returns frames; nothing is written.  Problems come back as rows, so
a target with a problem does not stop the others.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from changeledger.functions.selection import VersionSelection
from changeledger.functions.splitter import Dialect, POSTGRESQL
from changeledger.operators import history, pending as pending_ops, problems as problem_ops
from changeledger.operators.frames import contradictions, without_target
from changeledger.operators.report import info_report
from changeledger.operators.state import state_view
from changeledger.operators.statements import (
    DEFAULT_MARKS, dry_run, Marks, missing_texts, placeholder_problems, plan_texts)


@dataclass(frozen=True)
class Reconciler:
    """``targets``: target, and where used transactional, placeholders, builtins.

    ``catalog_problems``: problem rows of ``build_catalog``.  A target that has one
    is held back by ``plan``, ``record``, ``undo`` and the dry runs; the others
    go on.
    """

    catalog: DataFrame
    ledger: DataFrame
    targets: DataFrame | None = None
    selection: VersionSelection = VersionSelection()
    out_of_order: bool = False
    validate_first: bool = True
    by_directory: bool = False
    dialect: Dialect = POSTGRESQL
    substitution: bool = True
    marks: Marks = DEFAULT_MARKS
    catalog_problems: DataFrame | None = None

    def _targets(self) -> DataFrame:
        if self.targets is not None:
            return self.targets
        both = self.catalog.select("target").unionByName(self.ledger.select("target"))
        return both.distinct()

    # ------------------------------------------------------------- reading

    def state(self) -> DataFrame:
        return state_view(self.catalog, self.ledger)

    def info(self, ordered: bool = False) -> DataFrame:
        return info_report(self.state(), ordered)

    def validate(self) -> DataFrame:
        """Problems of items, and the rows without a target, which no other command uses."""
        return problem_ops.validation_problems(self.state()).unionByName(
            without_target(self.catalog, self.ledger))

    def plan(self) -> DataFrame:
        """Pending items.  Targets that fail validation (unless that is off) or whose
        catalog has problems get none.  Starts jobs for the facts about targets."""
        return pending_ops.pending(self.catalog, self.ledger, self.selection, self.out_of_order,
                                   self.by_directory, self._held())

    def _held(self) -> DataFrame | None:
        """(target, items) of the targets that are held back before any item is judged."""
        parts = []
        if self.validate_first:
            parts.append(problem_ops.invalid_targets(self.state()))
        if self.catalog_problems is not None:
            sizes = self.catalog.groupBy("target").agg(F.count("*").alias("items"))
            bad = self.catalog_problems.select("target").distinct()
            parts.append(bad.join(sizes, "target", "left").fillna(1, "items"))
        return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0] if parts else None

    def _gated(self, todo: DataFrame) -> DataFrame:
        """One planned row per target, without the targets whose catalog has problems."""
        if self.catalog_problems is None:
            return todo
        return todo.join(self.catalog_problems.select("target").distinct(), "target", "left_anti")

    def plan_problems(self) -> DataFrame:
        found = pending_ops.pending_problems(self.catalog, self.ledger, self.selection,
                                             self.out_of_order, self._targets())
        if self.targets is not None:
            found = found.unionByName(contradictions(self.targets))
        if self.catalog_problems is not None:
            found = found.unionByName(self.catalog_problems.select(*found.columns))
        if self.validate_first:
            return found.unionByName(self.validate()).distinct()
        return found.unionByName(without_target(self.catalog, self.ledger))

    def plan_warnings(self) -> DataFrame:
        return pending_ops.range_end_warning(self.catalog, self.selection,
                                             by_directory=self.by_directory)

    def dry_run(self, scripts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(statements of the plan, problems); a script with a problem has no statements."""
        return self._preview(self.plan(), scripts)

    def dry_run_undo(self, scripts: DataFrame) -> tuple[DataFrame, DataFrame]:
        plan, problems = self.undo()
        statements, more = self._preview(plan, scripts)
        return statements, problems.unionByName(more)

    def _preview(self, plan: DataFrame, scripts: DataFrame) -> tuple[DataFrame, DataFrame]:
        texts = plan_texts(plan, scripts)
        problems = placeholder_problems(texts if self.substitution else texts.limit(0),
                                        self.targets, self.marks)
        problems = problems.unionByName(missing_texts(plan, scripts))
        return dry_run(plan, scripts, self.targets, self.dialect, self.substitution, self.marks), problems

    # ------------------------------------------------------------- changing

    def record(self, outcomes: DataFrame, plan: DataFrame | None = None, installed_by: str = "",
               installed_on: datetime | Column | None = None) -> DataFrame:
        """Records to append after running ``plan`` (by default ``self.plan()``)."""
        return history.record_outcomes(self.plan() if plan is None else plan, outcomes,
                                       self._targets(), self.ledger, installed_by, installed_on)

    def record_problems(self, outcomes: DataFrame, plan: DataFrame | None = None) -> DataFrame:
        """Planned items without an outcome and targets without settings."""
        return history.record_problems(self.plan() if plan is None else plan, outcomes, self._targets())

    def baseline(self, version: str = "1", installed_by: str = "",
                 installed_on: datetime | Column | None = None) -> tuple[DataFrame, DataFrame]:
        return history.baseline(self._targets(), self.ledger, version, installed_by, installed_on)

    def undo(self) -> tuple[DataFrame, DataFrame]:
        plan, problems = history.undo_plan(self._targets(), self.catalog, self.ledger)
        if self.catalog_problems is not None:
            problems = problems.unionByName(self.catalog_problems.select(*problems.columns))
        return self._gated(plan), problems

    def repair(self) -> tuple[DataFrame, DataFrame]:
        return history.repair(self.catalog, self.ledger)

    def version_reached(self, plan: DataFrame | None = None) -> DataFrame:
        return history.version_reached(self.ledger, self.plan() if plan is None else plan)

    def summary(self, executed: DataFrame) -> DataFrame:
        """Per target: how many scripts a run executed, and the version reached."""
        counts = executed.groupBy("target").agg(F.count("*").alias("executed"))
        return counts.join(self.version_reached(executed), "target", "full_outer")
