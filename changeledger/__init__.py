"""Change-ledger reconciliation as PySpark DataFrame operators.

A *catalog* lists the versioned scripts a target should have, a *ledger* is the
append-only log of what was run there.  Everything is keyed by ``target`` so
that one Spark job reconciles a whole fleet.
"""

from changeledger.schema import LEDGER_SCHEMA, LedgerError
from changeledger.functions.selection import VersionSelection
from changeledger.functions.splitter import Dialect, MYSQL, ORACLE, POSTGRESQL
from changeledger.operators.problems import assert_no_problems
from changeledger.plans.commands import Reconciler

__all__ = [
    "Dialect",
    "LEDGER_SCHEMA",
    "LedgerError",
    "MYSQL",
    "ORACLE",
    "POSTGRESQL",
    "Reconciler",
    "VersionSelection",
    "assert_no_problems",
]
