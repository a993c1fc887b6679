"""The information report."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from changeledger.operators.state import display_order, effective
from changeledger.schema import BASELINE, REPEATABLE, SQL, UNDO_SQL

# Texts of the report.
REPEATABLE_LABEL = "(可重复)"
STATE_LABELS = {
    "PENDING": "待执行",
    "SUCCESS": "成功",
    "FAILED": "失败",
    "MISSING": "缺失",
    "OUT_OF_ORDER": "乱序",
    "FUTURE": "未来版本",
    "OUTDATED": "待更新",
    "BASELINE": "基准",
    "UNDONE": "已撤销",
}
TYPE_LABELS = {BASELINE: "基准", UNDO_SQL: "UNDO"}
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def _labels(labels: dict[str, str]):
    return F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])


def info_report(view: DataFrame, ordered: bool = False) -> DataFrame:
    """target, version, description, type, installed_on, execution_time and state as
    display texts.  ``ordered`` sorts the whole report by target and version."""
    has_catalog = F.col("resolved").isNotNull()
    version = F.when(has_catalog, F.col("resolved.version")).otherwise(F.col("applied.version"))
    kind = F.when(F.col("resolved.kind") == REPEATABLE, SQL).otherwise(
        F.coalesce(F.col("resolved.kind"), F.col("applied.type")))
    rows = view.orderBy("target", *display_order()) if ordered else view
    return rows.select(
        "target",
        F.coalesce(version, F.lit(REPEATABLE_LABEL)).alias("version"),
        effective("description").alias("description"),
        F.coalesce(F.try_element_at(_labels(TYPE_LABELS), kind), kind).alias("type"),
        F.coalesce(F.date_format("applied.installed_on", TIME_FORMAT), F.lit("-")).alias("installed_on"),
        F.coalesce(F.col("applied.execution_time").cast("string"), F.lit("-")).alias("execution_time"),
        F.try_element_at(_labels(STATE_LABELS), F.col("state")).alias("state"))
