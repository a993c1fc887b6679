"""The state of every item of every target, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from changeledger.operators.distribute import lookup
from changeledger.operators.frames import executable, is_snapshot, prepare_catalog, prepare_ledger
from changeledger.schema import BASELINE, UNDO_SQL

# Item states.
PENDING, OUT_OF_ORDER, SUCCESS, FAILED, MISSING, OUTDATED, FUTURE, UNDONE = (
    "PENDING", "OUT_OF_ORDER", "SUCCESS", "FAILED", "MISSING", "OUTDATED", "FUTURE", "UNDONE")
STATES = [PENDING, OUT_OF_ORDER, SUCCESS, FAILED, MISSING, OUTDATED, FUTURE, BASELINE, UNDONE]

RESOLVED_FIELDS = ["script", "kind", "version", "vsort", "description", "checksum"]
APPLIED_FIELDS = ["installed_rank", "version", "vsort", "description", "type", "script",
                  "checksum", "installed_by", "installed_on", "execution_time", "success"]


def latest_per_item(ledger: DataFrame) -> DataFrame:
    """(target, item_key, applied): the record with the highest rank of each item.

    The partial aggregation keeps one record per item before the shuffle, so
    re-runs of one item do not pile up.  A snapshot of a ledger has them already.
    """
    if is_snapshot(ledger):
        return ledger.select("target", "item_key", "applied")
    ledger = prepare_ledger(ledger)
    fields = [c for c in APPLIED_FIELDS if c in ledger.columns]
    return ledger.groupBy("target", "item_key").agg(
        F.max_by(F.struct(*fields), "installed_rank").alias("applied"))


def _bounds(items: DataFrame, latest: DataFrame) -> DataFrame:
    """Per target: highest version applied and in the catalog, and how many items."""
    live = F.col("applied.success") & (F.col("applied.type") != UNDO_SQL)
    none = F.lit(None).cast("string")
    both = latest.select("target", F.when(live, F.col("applied.vsort")).alias("a"), none.alias("r")) \
        .unionByName(items.select("target", none.alias("a"), F.col("vsort").alias("r")))
    return both.groupBy("target").agg(
        F.max("a").alias("highest_applied"), F.max("r").alias("highest_resolved"),
        F.count("*").alias("items"))


def _state() -> Column:
    resolved, applied = F.col("resolved"), F.col("applied")
    has_both = resolved.isNotNull() & applied.isNotNull()
    changed = ~resolved["checksum"].eqNullSafe(applied["checksum"])
    above_applied = F.col("highest_applied").isNull() | (resolved["vsort"] > F.col("highest_applied"))
    above_resolved = (F.col("highest_resolved").isNull()
                      | (applied["vsort"] > F.col("highest_resolved")))
    return (F.when(applied["type"] == BASELINE, BASELINE)
            .when(applied["type"] == UNDO_SQL, UNDONE)
            .when(~applied["success"], FAILED)
            .when(has_both & resolved["vsort"].isNull() & changed, OUTDATED)
            .when(has_both, SUCCESS)
            .when(resolved.isNotNull() & (resolved["vsort"].isNull() | above_applied), PENDING)
            .when(resolved.isNotNull(), OUT_OF_ORDER)
            .when(applied["vsort"].isNull() | above_resolved, FUTURE)
            .otherwise(MISSING))


def state_view(catalog: DataFrame, ledger: DataFrame) -> DataFrame:
    """Full outer join of catalog and latest records, one row per item:
    target, item_key, resolved (struct), applied (struct), state."""
    items = executable(prepare_catalog(catalog))
    latest = latest_per_item(ledger)
    resolved = items.select("target", "item_key", F.struct(*RESOLVED_FIELDS).alias("resolved"))
    view = lookup(resolved.join(latest, ["target", "item_key"], "full_outer"),
                  _bounds(items, latest), on=["target"], spread_by=["item_key"], weight="items")
    return view.select("target", "item_key", "resolved", "applied", _state().alias("state"))


def effective(field: str) -> Column:
    """Catalog value of a field, or the recorded one for items not in the catalog."""
    return F.coalesce(F.col(f"resolved.{field}"), F.col(f"applied.{field}"))


def display_order() -> list[Column]:
    """Order of a report within a target: by version, items without one last."""
    return [effective("vsort").asc_nulls_last(), F.coalesce(effective("description"), F.lit(""))]


def pending_view(view: DataFrame) -> DataFrame:
    return view.filter(F.col("state").isin(PENDING, OUT_OF_ORDER, OUTDATED))


def applied_view(view: DataFrame) -> DataFrame:
    return view.filter(F.col("state").isin(SUCCESS, BASELINE))


def current_version(view: DataFrame) -> DataFrame:
    """(target, version): the highest applied version, for targets that have one."""
    done = applied_view(view).filter("applied.vsort IS NOT NULL")
    return done.groupBy("target").agg(
        F.max_by("applied.version", "applied.vsort").alias("version"))


def state_counts(view: DataFrame) -> DataFrame:
    return view.groupBy("target", "state").agg(F.count("*").alias("items"))


def state_summary(view: DataFrame) -> DataFrame:
    """One row per target with a column per state."""
    return view.groupBy("target").agg(*(
        F.count_if(F.col("state") == s).alias(s.lower()) for s in STATES))
