import pytest
from pyspark.sql import functions as F

from changeledger.operators.problems import (
    ADVICE, CODES, assert_no_problems, problems_per_target, severity, validation_problems, with_explanations)
from changeledger.operators.report import info_report
from changeledger.operators.state import (
    applied_view, current_version, effective, pending_view, state_counts, state_summary, state_view)
from changeledger.plans.commands import Reconciler
from changeledger.schema import LedgerError
from conftest import rows


def states(items, records):
    view = state_view(items, records)
    return {(r.target, r.script): r.state for r in
            view.select("target", effective("script").alias("script"), "state").collect()}


# name, catalog, ledger, script -> state
CASES = [
    ("pending above", [("V", "2", 1)], [(1, "SQL", "1", 1, True)], "V2__2.sql", "PENDING"),
    ("pending nothing applied", [("V", "2", 1)], [], "V2__2.sql", "PENDING"),
    ("out of order", [("V", "1", 1)], [(1, "SQL", "2", 1, True)], "V1__1.sql", "OUT_OF_ORDER"),
    ("failed does not count as applied", [("V", "1", 1)], [(1, "SQL", "2", 1, False)], "V1__1.sql", "PENDING"),
    ("undone does not count as applied", [("V", "1", 1)], [(1, "UNDO_SQL", "2", 1, True)], "V1__1.sql", "PENDING"),
    ("baseline counts as applied", [("V", "1", 1)], [(1, "BASELINE", "2", None, True)], "V1__1.sql", "OUT_OF_ORDER"),
    ("success", [("V", "1", 1)], [(1, "SQL", "1.0", 1, True)], "V1__1.sql", "SUCCESS"),
    ("drift is still success", [("V", "1", 1)], [(1, "SQL", "1", 2, True)], "V1__1.sql", "SUCCESS"),
    ("failed", [("V", "1", 1)], [(1, "SQL", "1", 1, False)], "V1__1.sql", "FAILED"),
    ("failed without file", [], [(1, "SQL", "1", 1, False)], "V1__1.sql", "FAILED"),
    ("latest record counts", [("V", "1", 1)], [(1, "SQL", "1", 1, False), (2, "SQL", "1", 1, True)],
     "V1__1.sql", "SUCCESS"),
    ("missing", [("V", "2", 1)], [(1, "SQL", "1", 1, True)], "V1__1.sql", "MISSING"),
    ("future", [("V", "2", 1)], [(1, "SQL", "3", 1, True)], "V3__3.sql", "FUTURE"),
    ("future without catalog versions", [("R", "a", 1)], [(1, "SQL", "3", 1, True)], "V3__3.sql", "FUTURE"),
    ("repeatable without file", [("V", "1", 1)], [(1, "SQL", "R:a", 1, True)], "R__a.sql", "FUTURE"),
    ("repeatable never run", [("R", "a", 1)], [(1, "SQL", "1", 1, True)], "R__a.sql", "PENDING"),
    ("repeatable unchanged", [("R", "a", 1)], [(1, "SQL", "R:a", 1, True)], "R__a.sql", "SUCCESS"),
    ("repeatable changed", [("R", "a", 1)], [(1, "SQL", "R:a", 2, True)], "R__a.sql", "OUTDATED"),
    ("repeatable without checksums", [("R", "a", None)], [(1, "SQL", "R:a", None, True)], "R__a.sql", "SUCCESS"),
    ("repeatable with one checksum", [("R", "a", None)], [(1, "SQL", "R:a", 2, True)], "R__a.sql", "OUTDATED"),
    ("baseline", [("V", "1", 1)], [(1, "BASELINE", "1", None, True)], "V1__1.sql", "BASELINE"),
    ("undone", [("V", "1", 1)], [(1, "SQL", "1", 1, True), (2, "UNDO_SQL", "1", 9, True)], "V1__1.sql", "UNDONE"),
    ("failed undo shows as undone", [("V", "1", 1)], [(2, "UNDO_SQL", "1", 9, False)], "V1__1.sql", "UNDONE"),
]


def test_truth_table(catalog, ledger):
    """Every case is a target of its own, so one job shows that targets do not mix."""
    items = catalog(*[(name, *item) for name, some, _, _, _ in CASES for item in some])
    records = ledger(*[(name, *record) for name, _, some, _, _ in CASES for record in some])
    found = states(items, records)
    assert {name: found[(name, script)] for name, _, _, script, _ in CASES} == {
        name: state for name, _, _, _, state in CASES}


def test_undo_scripts_are_not_items(catalog, ledger):
    items = catalog(("t", "V", "1", 11), ("t", "V", "2", 22), ("t", "U", "2", 33))
    records = ledger(("t", 1, "SQL", "1", 11, True), ("t", 2, "UNDO_SQL", "1", 44, True))
    assert states(items, records) == {("t", "V1__1.sql"): "UNDONE", ("t", "V2__2.sql"): "PENDING"}


def test_empty_version_in_ledger_is_none(catalog, ledger):
    records = ledger(("t", 1, "SQL", "R:a", 5, True)).withColumn("version", F.lit(""))
    assert states(catalog(("t", "R", "a", 5)), records) == {("t", "R__a.sql"): "SUCCESS"}


@pytest.fixture
def mixed(catalog, ledger):
    items = catalog(("t", "V", "1", 1), ("t", "V", "2", 2), ("t", "R", "a", 3), ("t", "V", "5", 4), ("u", "V", "1", 1))
    records = ledger(("t", 1, "SQL", "1", 9, True), ("t", 2, "SQL", "2", 2, False), ("t", 3, "SQL", "3", 1, True),
                     ("t", 4, "SQL", "7", 1, True), ("u", 1, "SQL", "1", 1, True), ("t", 5, "SQL", "R:a", 3, True))
    return items, records


def test_problems(mixed):
    found = validation_problems(state_view(*mixed))
    assert rows(found, "target", "code", "script", "detail") == [
        ("t", "2003", "V1__1.sql", "checksum local=1 recorded=9"), ("t", "2003", "V3__3.sql", "MISSING"),
        ("t", "2003", "V7__7.sql", "FUTURE"), ("t", "2004", "V2__2.sql", "FAILED")]
    with pytest.raises(LedgerError) as error:
        assert_no_problems(found)
    assert error.value.problems.count() == 4 and "4 problems" in str(error.value)
    assert_no_problems(found.filter("target = 'u'"))
    assert rows(problems_per_target(found), "target", "code", "problems") == [("t", "2003", 3), ("t", "2004", 1)]


def test_item_with_two_problems(catalog, ledger):
    found = validation_problems(state_view(catalog(("t", "V", "1", 1)), ledger(("t", 1, "SQL", "1", 2, False))))
    assert rows(found, "code") == [("2003",), ("2004",)]


def test_checksum_problem_needs_both_sides(catalog, ledger):
    items = catalog(("t", "V", "1", None), ("t", "V", "2", 1), ("t", "V", "3", 1))
    records = ledger(("t", 1, "SQL", "1", 2, True), ("t", 2, "SQL", "2", None, True), ("t", 3, "UNDO_SQL", "3", 2, True))
    assert validation_problems(state_view(items, records)).count() == 0


def test_explanations(spark, mixed):
    found = with_explanations(validation_problems(state_view(*mixed)), from_validation=True)
    assert set(rows(found, "code", "summary", "severity")) == {
        ("2003", "Migration validation mismatch", 2), ("2004", "Failed migration needs repair", 2)}
    assert [c for c, _, _ in CODES] == sorted(ADVICE)
    codes = spark.createDataFrame([(c,) for c in ("1001", "2009", "3001", "4005")], "code string")
    assert [r[0] for r in codes.select(severity(F.col("code"))).collect()] == [1, 1, 3, 4]


def test_views(mixed):
    view = state_view(*mixed)
    assert rows(pending_view(view), "state") == [("OUT_OF_ORDER",)]
    assert rows(applied_view(view), "target", "state") == [("t", "SUCCESS"), ("t", "SUCCESS"), ("u", "SUCCESS")]
    assert rows(current_version(view), "target", "version") == [("t", "1"), ("u", "1")]
    assert rows(state_counts(view), "target", "state", "items") == [
        ("t", "FAILED", 1), ("t", "FUTURE", 1), ("t", "MISSING", 1), ("t", "OUT_OF_ORDER", 1), ("t", "SUCCESS", 2),
        ("u", "SUCCESS", 1)]
    summary = {r.target: (r.success, r.failed, r.undone) for r in state_summary(view).collect()}
    assert summary == {"t": (2, 1, 0), "u": (1, 0, 0)}


def test_report(mixed):
    found = info_report(state_view(*mixed).filter("target = 't'"), ordered=True).collect()
    assert [tuple(r)[1:] for r in found] == [
        ("1", "1", "SQL", "2024-01-01 00:00:01", "5", "成功"), ("2", "2", "SQL", "2024-01-01 00:00:02", "5", "失败"),
        ("3", "3", "SQL", "2024-01-01 00:00:03", "5", "缺失"), ("5", "5", "SQL", "-", "-", "乱序"),
        ("7", "7", "SQL", "2024-01-01 00:00:04", "5", "未来版本"),
        ("(可重复)", "a", "SQL", "2024-01-01 00:00:05", "5", "成功")]


def test_report_types(catalog, ledger):
    records = ledger(("t", 1, "BASELINE", "1", None, True), ("t", 2, "UNDO_SQL", "2", 1, True))
    found = info_report(state_view(catalog(("t", "V", "9", 1)), records))
    assert rows(found, "type", "state") == [("SQL", "待执行"), ("UNDO", "已撤销"), ("基准", "基准")]


def test_reconciler_reads(mixed):
    run = Reconciler(*mixed)
    assert run.info().count() == run.state().count() == 7
    assert run.validate().count() == 4


def test_ledger_is_aggregated_once(mixed):
    """The per-item aggregate serves the join and the bounds from one shuffle."""
    view = state_view(*mixed)
    view.collect()
    final = view._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final
