"""Frame schemas, fixed values and the library's exception."""

from __future__ import annotations

from pyspark.sql import types as T

LEDGER_SCHEMA = T.StructType([
    T.StructField("target", T.StringType(), False),
    T.StructField("installed_rank", T.IntegerType(), False),
    T.StructField("version", T.StringType(), True),
    T.StructField("description", T.StringType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("script", T.StringType(), False),
    T.StructField("checksum", T.IntegerType(), True),
    T.StructField("installed_by", T.StringType(), False),
    T.StructField("installed_on", T.TimestampType(), False),
    T.StructField("execution_time", T.IntegerType(), False),
    T.StructField("success", T.BooleanType(), False),
])
LEDGER_COLUMNS = LEDGER_SCHEMA.fieldNames()

PROBLEM_COLUMNS = ["target", "code", "script", "detail"]

# Ledger row types.
SQL = "SQL"
UNDO_SQL = "UNDO_SQL"
BASELINE = "BASELINE"

# Catalog kinds that are not ledger types.
REPEATABLE = "REPEATABLE"
CALLBACK = "CALLBACK"
IGNORED = "IGNORED"

# The record written by a baseline.
BASELINE_VERSION = "1"
BASELINE_DESCRIPTION = "baseline"
BASELINE_SCRIPT = "<< BASELINE >>"

# Problem codes.
INVALID_VERSION = "2001"
DUPLICATE_VERSION = "2002"
MISMATCH = "2003"
FAILED_NEEDS_REPAIR = "2004"
LEGACY_REPEATABLE = "2005"
OUT_OF_ORDER_CODE = "2006"
BASELINE_NOT_EMPTY = "2007"
MISSING_UNDO = "2008"
UNDEFINED_PLACEHOLDER = "2009"
EXECUTION_FAILED = "2010"
CONFLICT = "3001"
BAD_SETTING = "4002"
LOCATION_NOT_FOUND = "4005"


class LedgerError(Exception):
    """A mistake in the arguments, or problems the caller asked to have raised."""

    def __init__(self, code: str, message: str, problems=None):
        super().__init__(f"{code}: {message}")
        self.code = code
        self.problems = problems  # frame of all problem rows, where there is one
