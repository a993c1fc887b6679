from datetime import datetime

import pytest
from pyspark.sql import functions as F

from changeledger.functions.splitter import MYSQL
from changeledger.functions.versions import version_key_of
from changeledger.operators.frames import contradictions
from changeledger.operators.statements import resolve_text
from changeledger.operators.history import (
    baseline, record_outcomes, record_problems, repair, repair_counts, undo_plan, version_reached)
from changeledger.operators.pending import pending, with_progress
from changeledger.plans.commands import Reconciler
from changeledger.schema import LEDGER_SCHEMA, LedgerError
from conftest import rows

MOMENT = datetime(2024, 3, 1)


def outcomes(spark, *some):
    return spark.createDataFrame(list(some), "target string, script string, success boolean, elapsed_ms bigint")


def targets(spark, **transactional):
    return spark.createDataFrame(list(transactional.items()), "target string, transactional boolean")


def record_columns(frame):
    return rows(frame, "target", "installed_rank", "version", "type", "script", "success", "execution_time")


def test_baseline(spark, ledger):
    records, problems = baseline(targets(spark, a=True, b=True, c=True), ledger(("b", 1, "SQL", "1", 1, True)), "1.5", "me")
    assert rows(records, "target", "installed_rank", "version", "description", "type", "script", "checksum", "success") == [
        (t, 1, "1.5", "baseline", "BASELINE", "<< BASELINE >>", None, True) for t in "ac"]
    assert rows(problems, "target", "code") == [("b", "2007")]
    assert [f.dataType for f in records.schema] == [f.dataType for f in LEDGER_SCHEMA]
    with pytest.raises(LedgerError):
        baseline(targets(spark, a=True), records, "x")


def test_record_stops_at_first_failure(spark, catalog, ledger):
    items = catalog(*[(t, "V", v, 1) for t in "ab" for v in ("2", "3", "10")], ("a", "R", "r", 1), ("b", "R", "r", 1))
    records = ledger(("a", 7, "SQL", "1", 1, True))
    done = outcomes(spark, *[(t, f"V{v}__{v}.sql", v != "3", 3 * 10 ** 9) for t in "ab" for v in ("2", "3", "10")],
                    ("a", "R__r.sql", True, 1))
    found = record_outcomes(pending(items, records), done, targets(spark, a=True, b=False), records, "me", MOMENT)
    assert record_columns(found) == [
        ("a", 8, "2", "SQL", "V2__2.sql", True, 2147483647),
        ("b", 1, "2", "SQL", "V2__2.sql", True, 2147483647), ("b", 2, "3", "SQL", "V3__3.sql", False, 2147483647)]
    assert [f.dataType for f in found.schema] == [f.dataType for f in LEDGER_SCHEMA]


def test_a_run_stops_before_an_item_without_outcome(spark, catalog, ledger):
    items = catalog(*[(t, "V", v, 1) for t in "ab" for v in ("1", "2", "3")])
    records = ledger(("x", 1, "SQL", "1", 1, True))
    done = outcomes(spark, ("a", "V1__1.sql", True, 4), ("a", "V3__3.sql", True, 4), ("b", "V2__2.sql", True, 4))
    plan = pending(items, records)
    found = record_outcomes(plan, done, targets(spark, a=True), records, installed_on=MOMENT)
    assert record_columns(found) == [("a", 1, "1", "SQL", "V1__1.sql", True, 4)]
    assert rows(record_problems(plan, done, targets(spark, a=True)), "target", "code", "script") == [
        ("a", "2010", "V2__2.sql"), ("b", "2010", "V1__1.sql"), ("b", "2010", "V3__3.sql"), ("b", "4002", "")]


def test_a_target_without_settings_is_not_transactional(spark, catalog, ledger):
    items, records = catalog(("a", "V", "1", 1)), ledger(("a", 4, "SQL", "0", 1, True))
    found = record_outcomes(pending(items, records), outcomes(spark, ("a", "V1__1.sql", False, 4)),
                            targets(spark, z=True), records, installed_on=MOMENT)
    assert record_columns(found) == [("a", 5, "1", "SQL", "V1__1.sql", False, 4)]


def test_version_reached(catalog, ledger):
    items = catalog(("a", "V", "1.5", 1), ("b", "V", "1", 1), ("c", "V", "1", 1), ("d", "V", "3", 1))
    records = ledger(("a", 1, "SQL", "1.2", 1, True), ("b", 1, "SQL", "2.0", 1, True), ("b", 2, "SQL", "2", 1, True),
                     ("c", 1, "SQL", "9", 1, False), ("c", 2, "UNDO_SQL", "8", 1, True), ("c", 3, "SQL", "R:x", 1, True))
    plan = pending(items, records, out_of_order=True).filter("target <> 'c'")
    assert rows(version_reached(records, plan), "target", "version") == [("a", "1.5"), ("b", "2.0"), ("d", "3")]


def test_undo(spark, catalog, ledger):
    items = catalog(("a", "U", "2.0", 5), ("a", "U", "1", 5), ("b", "U", "1", 5), ("d", "U", "2", 5))
    records = ledger(
        ("a", 1, "SQL", "1", 1, True), ("a", 2, "SQL", "2", 1, True), ("a", 3, "SQL", "3", 1, True),
        ("a", 4, "UNDO_SQL", "3", 1, True), ("b", 1, "SQL", "2", 1, True), ("c", 1, "BASELINE", "1", None, True),
        ("d", 1, "SQL", "2", 1, True), ("d", 2, "SQL", "3", 1, False))
    plan, problems = undo_plan(targets(spark, a=True, b=True, c=True, d=True), items, records)
    assert rows(plan, "target", "undone_version", "script") == [
        ("a", "2", "U2.0__2.0.sql"), ("d", "2", "U2__2.sql")]
    assert rows(problems, "target", "code", "detail") == [
        ("b", "2008", "no undo script for version 2"), ("c", "2008", "nothing to undo")]
    written = record_outcomes(plan, outcomes(spark, ("a", "U2.0__2.0.sql", True, 3)), targets(spark, a=True), records,
                              installed_on=MOMENT)
    assert record_columns(written) == [("a", 5, "2.0", "UNDO_SQL", "U2.0__2.0.sql", True, 3)]
    again = undo_plan(targets(spark, a=True), items, records.unionByName(written))[0]
    assert rows(again, "undone_version") == [("1",)]


def test_repair(catalog, ledger):
    items = catalog(("t", "V", "1", 10), ("t", "V", "2", 20), ("t", "V", "3", 30), ("t", "V", "4", None),
                    ("t", "V", "5", 50), ("t", "R", "a", 60), ("t", "U", "1", 70))
    records = ledger(
        ("t", 1, "SQL", "1", 11, True), ("t", 2, "SQL", "1", 12, True), ("t", 3, "SQL", "2", 20, True),
        ("t", 4, "SQL", "3", 31, False), ("t", 5, "SQL", "4", 41, True), ("t", 6, "BASELINE", "5", None, True),
        ("t", 7, "SQL", "R:a", 61, True), ("t", 8, "UNDO_SQL", "1", 71, True), ("u", 1, "SQL", "1", 99, True))
    fixed, report = repair(items, records)
    assert rows(report, "action", "script") == [
        ("aligned", "V1__1.sql"), ("aligned", "V4__4.sql"), ("removed", "V3__3.sql")]
    assert rows(fixed, "target", "installed_rank", "checksum") == [
        ("t", 1, 10), ("t", 2, 10), ("t", 3, 20), ("t", 5, None), ("t", 6, None), ("t", 7, 61), ("t", 8, 71), ("u", 1, 99)]
    assert fixed.columns == records.columns
    assert rows(repair_counts(report), "target", "removed", "aligned") == [("t", 1, 2)]
    twice, nothing = repair(items, fixed)
    assert sorted(map(tuple, twice.collect()), key=repr) == sorted(map(tuple, fixed.collect()), key=repr)
    assert nothing.count() == 0


@pytest.mark.parametrize("transactional", [True, False])
def test_failure_then_repair_then_rerun(spark, catalog, ledger, transactional):
    """A rolled-back failure leaves no record; otherwise the record blocks until repaired."""
    items, records = catalog(("t", "V", "1", 1), ("t", "V", "2", 2)), ledger(("x", 1, "SQL", "1", 1, True))
    where = targets(spark, t=transactional)
    first = outcomes(spark, ("t", "V1__1.sql", True, 1), ("t", "V2__2.sql", False, 1))
    run = Reconciler(items, records, where)
    records = records.unionByName(run.record(first, installed_on=MOMENT)).checkpoint()
    assert records.filter("target = 't' AND NOT success").count() == (0 if transactional else 1)
    run = Reconciler(items, records, where)
    if not transactional:
        assert run.plan().count() == 0
        assert rows(run.plan_problems(), "target", "code") == [("t", "2004"), ("t", "2004"), ("x", "2003")]
        records = run.repair()[0].checkpoint()
        run = Reconciler(items, records, where)
    assert rows(run.plan(), "script") == [("V2__2.sql",)]
    written = run.record(outcomes(spark, ("t", "V2__2.sql", True, 1)), installed_on=MOMENT)
    assert rows(run.summary(written.withColumn("vsort", F.lit(version_key_of("2")))), "target", "executed", "version") == [
        ("t", 1, "2"), ("x", None, "1")]
    records = records.unionByName(written)
    run = Reconciler(items, records, where)
    assert run.plan().count() == 0
    assert rows(run.state().filter("target = 't'"), "state") == [("SUCCESS",), ("SUCCESS",)]


def test_dry_run(spark, catalog, ledger):
    items, records = catalog(("a", "V", "2", 1), ("a", "V", "10", 1), ("b", "V", "2", 1), ("a", "U", "1", 1)), ledger(
        ("a", 1, "SQL", "1", 1, True))
    items = items.unionByName(catalog(("a", "V", "1", 1)))
    texts = spark.createDataFrame(
        [("a", "V2__2.sql", "-- x\nCREATE ${name};\nB;"), ("a", "V10__10.sql", "C ${ledger:user}"),
         ("b", "V2__2.sql", "A;\n${nope};"), ("a", "V1__1.sql", "never"), ("a", "U1__1.sql", "DROP ${name};")],
        "target string, script string, text string")
    where = spark.createDataFrame([("a", True, {"name": "n"}, {"user": "me"}), ("b", True, None, None)],
                                  "target string, transactional boolean, placeholders map<string,string>, "
                                  "builtins map<string,string>")
    run = Reconciler(items, records, where)
    statements, problems = run.dry_run(texts)
    found = statements.orderBy("target", "run_order", "stmt_no").collect()
    assert [(r.script, r.stmt_no, r.line, r.sql) for r in found] == [
        ("V2__2.sql", 1, 2, "-- x\nCREATE n"), ("V2__2.sql", 2, 3, "B"), ("V10__10.sql", 1, 1, "C me")]
    assert rows(problems, "target", "code", "script", "detail") == [("b", "2009", "V2__2.sql", "nope in line 2")]
    statements, problems = run.dry_run_undo(texts)
    assert rows(statements, "target", "kind", "sql") == [("a", "UNDO_SQL", "DROP n")]
    assert rows(problems, "target", "code") == [("b", "2008")]
    plain = Reconciler(items, records, where, substitution=False, dialect=MYSQL)
    statements, problems = plain.dry_run(texts)
    assert statements.count() == 5 and problems.count() == 0


def test_repeated_outcomes_and_settings(spark, catalog, ledger):
    """One record per item whatever is repeated; a failed outcome counts, and every case is a problem row."""
    items, records = catalog(*[(t, "V", v, 1) for t in "ab" for v in "12"]), ledger(("a", 4, "SQL", "0", 1, True))
    done = outcomes(spark, ("a", "V1__1.sql", True, 4), ("a", "V1__1.sql", False, 9), ("a", "V2__2.sql", True, 4),
                    ("b", "V1__1.sql", True, 5), ("b", "V1__1.sql", True, 5), ("b", "V2__2.sql", True, 4), ("b", "V2__2.sql", None, 4))
    settings = targets(spark, a=False, b=True).union(targets(spark, a=False, b=False))
    plan = pending(items, records)
    found = record_outcomes(plan, done, settings, records, installed_on=MOMENT)
    assert record_columns(found) == [
        ("a", 5, "1", "SQL", "V1__1.sql", False, 9), ("b", 1, "1", "SQL", "V1__1.sql", True, 5), ("b", 2, "2", "SQL", "V2__2.sql", True, 4)]
    assert rows(record_problems(plan, done, settings), "target", "code", "script", "detail") == [
        ("a", "2010", "V1__1.sql", "2 outcomes"), ("b", "2010", "V1__1.sql", "2 outcomes"),
        ("b", "4002", "", "settings that contradict each other")]


def test_record_without_settings(spark, catalog, ledger):
    items, records = catalog(("a", "V", "1", 1), ("a", "V", "2", 1)), ledger(("a", 4, "SQL", "0", 1, True))
    done = outcomes(spark, ("a", "V1__1.sql", True, 4), ("a", "V2__2.sql", False, 4))
    run = Reconciler(items, records, validate_first=False)
    assert record_columns(run.record(done, installed_on=MOMENT)) == [
        ("a", 5, "1", "SQL", "V1__1.sql", True, 4), ("a", 6, "2", "SQL", "V2__2.sql", False, 4)]
    assert run.record_problems(done).count() == 0


def test_repeated_settings_of_placeholders(spark):
    texts = spark.createDataFrame([("a", "s", "SQL", "select ${x};")], "target string, script string, kind string, text string")
    values = spark.createDataFrame([("a", {"x": "2"}), ("a", {"x": "1"}), ("a", {"x": "1"})], "target string, placeholders map<string,string>")
    assert rows(resolve_text(texts, values), "target", "text") == [("a", "select 1;")]
    assert rows(contradictions(values), "target", "code") == [("a", "4002")]
    assert contradictions(values.limit(0)).count() == 0


def test_rows_without_a_target(spark, catalog, ledger):
    """They are left out, or left as they are, and every command that meets them says so."""
    items = catalog(("a", "V", "1", 2), (None, "V", "1", 1), (None, "U", "1", 1))
    strict = ledger(("a", 1, "SQL", "1", 1, True), ("n", 2, "SQL", "1", 1, False), ("n", 3, "SQL", "1", 1, True))
    records = strict.withColumn("target", F.nullif("target", F.lit("n"))).withColumn("version", F.when(F.col("installed_rank") == 1, "1").otherwise(""))
    run = Reconciler(items, records, validate_first=True)
    lost = [(None, "4002", s, "a row without a target") for s in ("U1__1.sql", "V1__1.sql", "V1__1.sql", "V1__1.sql")]
    assert rows(run.validate(), "target", "code", "script", "detail") == sorted(lost + [("a", "2003", "V1__1.sql", "checksum local=2 recorded=1")], key=repr)
    found = rows(run.plan_problems(), "target", "code", "script", "detail")
    assert set(lost) <= set(found) and not [r for r in found if r[0] is None and r not in lost]
    assert rows(run.state(), "target") == [("a",)] and run.plan().count() == 0
    new, report = run.repair()
    assert rows(new, "target", "installed_rank", "version", "checksum", "success") == [
        ("a", 1, "1", 2, True), (None, 2, "", 1, False), (None, 3, "", 1, True)]
    assert rows(report, "target", "action") == [("a", "aligned"), (None, "left"), (None, "left")]
    assert rows(repair_counts(report), "target", "removed", "aligned") == [("a", 0, 1)]
    assert rows(run.undo()[0], "target") == []


def test_repair_keeps_blank_versions(catalog, ledger):
    records = ledger(("a", 1, "SQL", "R:x", 1, True), ("a", 2, "SQL", "2", 1, False)).withColumn("version", F.coalesce("version", F.lit("")))
    assert rows(repair(catalog(("a", "V", "2", 1)), records)[0], "version", "installed_rank") == [("", 1)]
