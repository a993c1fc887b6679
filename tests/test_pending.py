import pytest

from changeledger.functions.selection import VersionSelection
from changeledger.operators.pending import failed_gate, pending, pending_problems, verdicts, with_progress
from changeledger.plans.commands import Reconciler
from conftest import rows


def judged(items, records, **options):
    return {(r.target, r.script): r.verdict for r in verdicts(items, records, **options).collect()}


CASES = [
    ("nothing applied", [("V", "1", 1)], [], "V1__1.sql", "pending"),
    ("above highest", [("V", "2", 1)], [(1, "SQL", "1", 1, True)], "V2__2.sql", "pending"),
    ("below highest", [("V", "1", 1)], [(1, "SQL", "2", 1, True)], "V1__1.sql", "out_of_order"),
    ("applied", [("V", "1", 1)], [(1, "SQL", "1.0", 1, True)], "V1__1.sql", "skip_applied"),
    ("undone pends again", [("V", "1", 1)], [(1, "SQL", "1", 1, True), (2, "UNDO_SQL", "1", 1, True)],
     "V1__1.sql", "pending"),
    ("undone below highest", [("V", "1", 1)],
     [(1, "SQL", "1", 1, True), (2, "SQL", "2", 1, True), (3, "UNDO_SQL", "1", 1, True)], "V1__1.sql", "out_of_order"),
    ("at the baseline", [("V", "2", 1)], [(1, "BASELINE", "2", None, True)], "V2__2.sql", "skip_baseline"),
    ("below the baseline", [("V", "1", 1)], [(1, "BASELINE", "2", None, True)], "V1__1.sql", "skip_baseline"),
    ("baseline is not applied", [("V", "3", 1)], [(1, "BASELINE", "2", None, True)], "V3__3.sql", "pending"),
    ("failed blocks", [("V", "9", 1)], [(1, "SQL", "1", 1, False)], "V9__9.sql", "blocked"),
    ("failed undo blocks", [("V", "9", 1)], [(1, "UNDO_SQL", "1", 1, False)], "V9__9.sql", "blocked"),
    ("repeatable never run", [("R", "a", 1)], [(1, "SQL", "1", 1, True)], "R__a.sql", "pending"),
    ("repeatable changed", [("R", "a", 1)], [(1, "SQL", "R:a", 2, True)], "R__a.sql", "pending"),
    ("repeatable unchanged", [("R", "a", 1)], [(1, "SQL", "R:a", 2, True), (2, "SQL", "R:a", 1, True)],
     "R__a.sql", "skip_unchanged"),
    ("repeatable without checksum", [("R", "a", None)], [(1, "SQL", "R:a", 2, True)], "R__a.sql", "skip_unchanged"),
    ("recorded without checksum", [("R", "a", 1)], [(1, "SQL", "R:a", None, True)], "R__a.sql", "pending"),
]


def test_rules(catalog, ledger):
    items = catalog(*[(name, *item) for name, some, _, _, _ in CASES for item in some])
    records = ledger(*[(name, *record) for name, _, some, _, _ in CASES for record in some])
    found = judged(items, records)
    assert {name: found[(name, script)] for name, _, _, script, _ in CASES} == {
        name: verdict for name, _, _, _, verdict in CASES}
    late = {target for (target, _), verdict in judged(items, records, out_of_order=True).items()
            if verdict == "pending"} - {t for (t, _), v in found.items() if v == "pending"}
    assert late == {"below highest", "undone below highest"}


@pytest.fixture
def fleet(catalog, ledger):
    items = catalog(("a", "V", "10", 1), ("a", "V", "9", 1), ("a", "R", "z", 1), ("a", "R", "b", 1), ("a", "U", "9", 1),
                    ("late", "V", "1", 1), ("late", "V", "3", 1), ("bad", "V", "4", 1))
    records = ledger(("late", 1, "SQL", "2", 1, True), ("bad", 1, "SQL", "1", 1, False),
                     ("bad", 2, "SQL", "2", 1, False))
    return items, records


def test_pending_and_order(fleet):
    assert rows(pending(*fleet), "target", "script") == [
        ("a", "R__b.sql"), ("a", "R__z.sql"), ("a", "V10__10.sql"), ("a", "V9__9.sql")]
    steps = with_progress(pending(*fleet, out_of_order=True)).orderBy("target", "step").collect()
    assert [(r.target, r.step, r.steps, r.script) for r in steps] == [
        ("a", 1, 4, "V9__9.sql"), ("a", 2, 4, "V10__10.sql"), ("a", 3, 4, "R__b.sql"), ("a", 4, 4, "R__z.sql"),
        ("late", 1, 2, "V1__1.sql"), ("late", 2, 2, "V3__3.sql")]


def test_problems(fleet):
    assert rows(failed_gate(fleet[1]), "target", "script") == [("bad", "V1__1.sql")]
    assert rows(pending_problems(*fleet), "target", "code", "script") == [
        ("bad", "2004", "V1__1.sql"), ("late", "2006", "V1__1.sql")]
    found = pending_problems(*fleet, selection=VersionSelection(mode="family", target="9"), out_of_order=True)
    assert rows(found, "target", "code") == [("bad", "2001"), ("bad", "2004"), ("late", "2001")]


def test_selection_drops_repeatables(fleet):
    found = pending(*fleet, selection=VersionSelection(start="9"))
    assert rows(found, "script") == [("V10__10.sql",), ("V9__9.sql",)]


def test_directory_order(spark, catalog, ledger):
    items = catalog(("t", "V", "1.5", 1), ("t", "V", "2.1", 1), ("t", "V", "1.7", 1)).selectExpr(
        "*", "CASE version WHEN '1.5' THEN '3' WHEN '2.1' THEN '2' ELSE '10' END AS dir_version")
    plan = with_progress(pending(items, ledger(("x", 1, "SQL", "1", 1, True)), by_directory=True))
    assert [r.version for r in plan.orderBy("step").collect()] == ["2.1", "1.5", "1.7"]
    chosen = pending(items, ledger(("x", 1, "SQL", "1", 1, True)), VersionSelection(start="3", by_directory=True))
    assert rows(chosen, "version") == [("1.5",), ("1.7",)]


def test_validation_gate(catalog, ledger):
    items = catalog(("good", "V", "1", 1), ("good", "V", "2", 1), ("drift", "V", "1", 1), ("drift", "V", "2", 1))
    records = ledger(("good", 1, "SQL", "1", 1, True), ("drift", 1, "SQL", "1", 7, True))
    assert rows(Reconciler(items, records).plan(), "target", "script") == [("good", "V2__2.sql")]
    assert Reconciler(items, records, validate_first=False).plan().count() == 2
    assert rows(Reconciler(items, records).plan_problems(), "target", "code") == [("drift", "2003")]
