"""Problem rows: (target, code, script, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from changeledger.operators.state import FAILED, FUTURE, MISSING, effective
from changeledger.schema import FAILED_NEEDS_REPAIR, LedgerError, MISMATCH, PROBLEM_COLUMNS, UNDO_SQL

# Problems that an error message shows; the error carries all of them.
SAMPLE = 20

# Problem codes with their short texts.
CODES = [
    ("2001", "Invalid version number", "非法版本号"),
    ("2002", "Duplicate version", "重复版本"),
    ("2003", "Migration validation mismatch", "迁移校验不一致"),
    ("2004", "Failed migration needs repair", "存在失败记录需 repair"),
    ("2005", "Legacy R-prefix naming", "旧式 R 前缀命名"),
    ("2006", "Out-of-order migration", "乱序迁移"),
    ("2007", "Baseline precondition unmet", "baseline 前置不满足"),
    ("2008", "Missing undo script", "缺少 undo 脚本"),
    ("2009", "Undefined placeholder", "未定义占位符"),
    ("2010", "Migration execution failed", "迁移执行失败"),
    ("3001", "Lock acquisition timed out", "获取迁移锁超时"),
    ("4001", "Unknown config key", "未知配置键"),
    ("4002", "Missing required config", "缺少必填配置项"),
    ("4005", "Migration location not found", "迁移位置不存在"),
]

# What leads this library to a code, and what its user can do.
ADVICE = {
    "2001": ("No version could be read from a name, it is outside its folder's family, or a "
             "selection found nothing.", "Correct the name, move the file or change the selection."),
    "2002": ("A version, or a path of several locations, is there more than once.",
             "Keep one of the scripts that the rows name."),
    "2003": ("Catalog and ledger disagree about a script that ran.",
             "Bring back the script, or take over its new checksum with repair()."),
    "2004": ("The latest record of an item is a failure.", "Correct the script, then repair()."),
    "2005": ("A repeatable has a number.", "Take the number out of its name."),
    "2006": ("An item is older than what its target has reached.",
             "Plan with out_of_order, or number it anew."),
    "2007": ("The target has records already.", "Leave it out of the baseline."),
    "2008": ("Nothing can be taken back, or the catalog lacks the script for it.",
             "Add an undo script of the version in the detail."),
    "2009": ("A text uses a name without a value.", "Add the name to the target's placeholders."),
    "2010": ("A script stopped, has no text, or its outcome is not known.",
             "Look at the statement or script that the row names, then plan again."),
    "3001": ("Another run appended records to a target after this run was planned.",
             "Plan again from the ledger as it is now."),
    "4001": ("A setting has a name that is not known.", "Take the nearest known name."),
    "4002": ("A setting or a column that a row needs is missing or cannot be read.", "Supply it."),
    "4005": ("A folder of scripts is not there.", "Correct its location."),
}


def _found() -> Column:
    """The problems of one row of a state view, as an array."""
    local, recorded = F.col("resolved.checksum"), F.col("applied.checksum")
    changed = (F.col("resolved.vsort").isNotNull() & (F.col("applied.type") != UNDO_SQL)
               & (local != recorded))
    state = F.col("state")

    def problem(when: Column, code: str, detail: Column) -> Column:
        return F.when(when, F.struct(F.lit(code).alias("code"), detail.alias("detail")))

    return F.array_compact(F.array(
        problem(changed, MISMATCH, F.concat(F.lit("checksum local="), local.cast("string"),
                                            F.lit(" recorded="), recorded.cast("string"))),
        problem(state == FAILED, FAILED_NEEDS_REPAIR, F.lit("FAILED")),
        problem(state.isin(MISSING, FUTURE), MISMATCH, state)))


def validation_problems(view: DataFrame) -> DataFrame:
    """Changed, failed, missing and too-new items of a state view; an item may have two."""
    return (view.select("target", effective("script").alias("script"), F.inline(_found()))
            .select(*PROBLEM_COLUMNS))


def invalid_targets(view: DataFrame) -> DataFrame:
    """(target, items) of the targets that have a problem, with the number of their items."""
    return view.groupBy("target").agg(
        F.count_if(F.size(_found()) > 0).alias("bad"), F.count("*").alias("items")) \
        .filter("bad > 0").drop("bad")


def severity(code: Column) -> Column:
    """Exit status a command line would give: 2 for failed validation (2003, 2004)
    is decided by the caller; here 3xxx gives 3, 4xxx gives 4, anything else 1."""
    return F.when(code.startswith("3"), 3).when(code.startswith("4"), 4).otherwise(1)


def with_explanations(problems: DataFrame, from_validation: bool = False) -> DataFrame:
    """Add texts and severity; problems of a validation have severity 2."""
    rows = [(*code, *ADVICE[code[0]]) for code in CODES]
    codes = problems.sparkSession.createDataFrame(
        rows, "code string, summary string, summary_zh string, cause string, action string")
    level = F.lit(2) if from_validation else severity(F.col("code"))
    return (problems.join(F.broadcast(codes), "code", "left")  # as many rows as CODES
            .withColumn("severity", level))


def problems_per_target(problems: DataFrame) -> DataFrame:
    """Number of problems by target and code."""
    return problems.groupBy("target", "code").agg(F.count("*").alias("problems"))


def assert_no_problems(problems: DataFrame) -> None:
    """Raise LedgerError if there are problems.

    The message has their number and a sample; ``problems`` of the error is the
    whole frame.
    """
    found = problems.select(*PROBLEM_COLUMNS)
    sample = found.take(SAMPLE)
    if sample:
        count = len(sample) if len(sample) < SAMPLE else found.count()
        lines = "; ".join(f"{r.target} {r.code} {r.script}: {r.detail}" for r in sample)
        raise LedgerError(sample[0].code, f"{count} problems, for example {lines}", found)
