"""Ledgers of commits: repeated and conflicting appends, repair of changed parts alone, growing snapshots."""

import os
import random
from pathlib import Path

import pytest

from changeledger.functions.selection import VersionSelection
from changeledger.operators import history, pending as pending_ops
from changeledger.operators.problems import validation_problems
from changeledger.operators.snapshot import SNAPSHOT_COLUMNS, ledger_snapshot, merge_snapshots
from changeledger.operators.state import state_view
from changeledger.plans.commands import Reconciler
from changeledger.schema import LEDGER_COLUMNS, LEDGER_SCHEMA, LedgerError
from changeledger.sources.commits import advance_snapshot, append_run, last_commit, read_commits, repair_in_place
from conftest import rows


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("commit=*/**/*.parquet")}


def random_ledger(seed, n=300):
    r = random.Random(seed)
    found = []
    for rank in range(1, n + 1):
        kind = r.choice(["SQL"] * 8 + ["UNDO_SQL", "BASELINE"])
        version = r.choice([f"{r.randint(1, 9)}.{r.randint(0, 3)}", f"{r.randint(1, 9)}.{r.randint(0, 3)}.0", "R:x", "R:y"])
        if kind == "BASELINE":
            version = f"{r.randint(0, 2)}"
        found.append((r.choice("aabcdefgh"), rank, kind, version, r.choice([1, 1, 1, 2, None]), r.random() > 0.05))
    return found


def items():
    return [(t, k, v, 1) for t in "abcdefghz" for k, v in
            [("V", f"{a}.{b}") for a in range(1, 11) for b in range(3)] + [("R", "x"), ("R", "z"), ("U", "3.1"), ("U", "9.0"), ("U", "8.2")]]


def test_a_run_is_appended_once(spark, ledger, tmp_path):
    path = str(tmp_path / "ledger")
    assert last_commit(spark, path) == -1 and read_commits(spark, path).count() == 0
    first = ledger(("a", 1, "SQL", "1", 1, True), ("b", 1, "SQL", "1", 1, True))
    assert append_run(first, path, "r1", -1, parts=4).count() == 0
    before = files(path)
    assert append_run(first, path, "r1", -1).count() == 0
    assert append_run(first, path, "r1", 0).count() == 0
    assert files(path) == before and last_commit(spark, path) == 0
    found = read_commits(spark, path)
    assert rows(found.select(*LEDGER_COLUMNS), "target", "installed_rank") == [("a", 1), ("b", 1)]
    assert found.schema[:len(LEDGER_COLUMNS)].fieldNames() == LEDGER_COLUMNS
    with pytest.raises(LedgerError):
        append_run(first, path, "r/1", -1)


def test_two_plans_from_one_state(spark, ledger, tmp_path):
    path = str(tmp_path / "ledger")
    append_run(ledger(("a", 1, "SQL", "1", 1, True), ("b", 1, "SQL", "1", 1, True)), path, "r1", -1)
    one = ledger(("a", 2, "SQL", "2", 1, True), ("a", 3, "SQL", "3", 1, True))
    two = ledger(("a", 2, "SQL", "2", 1, True), ("b", 2, "SQL", "2", 1, True), ("c", 1, "SQL", "2", 1, True))
    assert append_run(one, path, "r2", 0).count() == 0
    conflicts = append_run(two, path, "r3", 0)
    assert rows(conflicts, "target", "code", "detail") == [("a", "3001", "records added by commit 1")]
    assert rows(read_commits(spark, path), "target", "installed_rank", "run") == [
        ("a", 1, "r1"), ("a", 2, "r2"), ("a", 3, "r2"), ("b", 1, "r1"), ("b", 2, "r3"), ("c", 1, "r3")]
    third = append_run(ledger(("b", 2, "SQL", "9", 1, True)), path, "r4", 0)
    assert rows(third, "target") == [("b",)] and last_commit(spark, path) == 2
    assert not [n for n in os.listdir(path) if n.startswith("_staged")]


def test_a_commit_number_is_taken_once(spark, ledger, tmp_path, monkeypatch):
    """Another run publishes between comparing and publishing: the run compares again."""
    from changeledger.sources import commits

    path = str(tmp_path / "ledger")
    append_run(ledger(("a", 1, "SQL", "1", 1, True)), path, "r1", -1)
    publish, other = commits._Folder.publish, []

    def late(folder, source, name):
        if not other:
            other.append(name)
            append_run(ledger(("a", 2, "SQL", "7", 1, True)), path, "r2", 0)
        return publish(folder, source, name)

    monkeypatch.setattr(commits._Folder, "publish", late)
    conflicts = append_run(ledger(("a", 2, "SQL", "2", 1, True), ("b", 1, "SQL", "2", 1, True)), path, "r3", 0)
    assert rows(conflicts, "target", "detail") == [("a", "records added by commit 1")]
    assert rows(read_commits(spark, path), "target", "installed_rank", "run", "commit") == [
        ("a", 1, "r1", 0), ("a", 2, "r2", 1), ("b", 1, "r3", 2)]


def test_repair_writes_changed_parts_alone(spark, catalog, ledger, tmp_path):
    path = str(tmp_path / "ledger")
    records = [(f"t{i}", 1, "SQL", "1", 1, True) for i in range(60)] + [("t7", 2, "SQL", "2", 5, True), ("gone", 1, "SQL", "1", 1, False)]
    whole = ledger(*records)
    append_run(whole, path, "r1", -1, parts=32)
    later = ledger(("t7", 3, "SQL", "3", 9, True), ("t8", 2, "SQL", "2", 5, False), ("gone", 2, "SQL", "1", 1, False))
    append_run(later, path, "r2", 0, parts=32)
    items_ = catalog(("t7", "V", "2", 6), ("t7", "V", "3", 9), ("t8", "V", "1", 1))
    expected, report = history.repair(items_, whole.unionByName(later))
    wanted, actions = rows(expected, *LEDGER_COLUMNS), rows(report, "target", "action", "script")
    before = files(path)
    found = repair_in_place(items_, path)
    assert rows(found, "target", "action", "script") == actions
    assert rows(read_commits(spark, path), *LEDGER_COLUMNS) == wanted
    after = files(path)
    kept = {n for n in before if after.get(n) == before[n]}
    changed = {n.rsplit("/", 1)[0] for n in before if n not in kept}
    assert len(changed) <= 4 and len(kept) >= 20
    assert {n.rsplit("/", 1)[0] for n in after if n not in kept} <= changed
    assert repair_in_place(items_, path).count() == 0 and files(path) == after


def test_repair_of_nothing(spark, catalog, ledger, tmp_path):
    assert repair_in_place(catalog(("a", "V", "1", 1)), str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_merged_snapshots_equal_the_whole(spark, ledger, seed):
    records = random_ledger(seed)
    r = random.Random(seed)
    dealt = [r.randrange(4) for _ in records]
    parts = [ledger_snapshot(ledger(*[x for x, d in zip(records, dealt) if d == i] or [("q", 1, "SQL", "1", 1, True)])) for i in range(4)]
    whole = ledger_snapshot(ledger(*records, *([("q", 1, "SQL", "1", 1, True)] if set(dealt) != set(range(4)) else [])))
    assert rows(merge_snapshots(*parts), *SNAPSHOT_COLUMNS) == rows(whole, *SNAPSHOT_COLUMNS)


@pytest.mark.parametrize("seed", [3, 4])
def test_a_snapshot_serves_as_the_ledger(spark, catalog, ledger, seed):
    whole, things = ledger(*random_ledger(seed)), catalog(*items())
    snapshot = ledger_snapshot(whole)
    columns = ["target", "item_key", "resolved", "applied", "state"]
    assert rows(state_view(things, snapshot), *columns) == rows(state_view(things, whole), *columns)
    for strict in (True, False):
        a, b = (pending_ops.verdicts(things, x, VersionSelection(), strict) for x in (snapshot, whole))
        assert rows(a, "target", "script", "verdict") == rows(b, "target", "script", "verdict")
    assert rows(pending_ops.failed_gate(snapshot), "target", "script") == rows(pending_ops.failed_gate(whole), "target", "script")
    assert rows(history.highest_rank(snapshot), "target", "highest_rank") == rows(history.highest_rank(whole), "target", "highest_rank")
    assert rows(history.undo_targets(snapshot), "target", "version") == rows(history.undo_targets(whole), "target", "version")
    one, two = (Reconciler(things, x, out_of_order=True) for x in (snapshot, whole))
    for a, b in [(one.validate(), two.validate()), (one.plan_problems(), two.plan_problems())]:
        assert rows(a, "target", "code", "script", "detail") == rows(b, "target", "code", "script", "detail")
    assert rows(one.undo()[0], "target", "script") == rows(two.undo()[0], "target", "script")
    for call in (one.repair, lambda: one.version_reached(two.plan())):
        with pytest.raises(LedgerError):
            call()


def test_snapshots_grow_by_new_commits(spark, catalog, ledger, tmp_path):
    path, state = str(tmp_path / "ledger"), str(tmp_path / "state")
    records = random_ledger(8)
    assert advance_snapshot(spark, path, state).count() == 0
    for run, part in enumerate((records[:200], records[200:210], records[210:])):
        append_run(ledger(*part), path, f"r{run}", 10 ** 6)
        if run == 1:
            newer = read_commits(spark, path, after=0)
            scan = newer._jdf.queryExecution().executedPlan().toString()
            assert "PartitionFilters" in scan and "commit" in scan.split("PartitionFilters")[1].split("]")[0]
        found = advance_snapshot(spark, path, state)
        whole = ledger_snapshot(read_commits(spark, path))
        assert rows(found, *SNAPSHOT_COLUMNS) == rows(whole, *SNAPSHOT_COLUMNS)
    assert sorted(os.listdir(f"{state}/repairs=0")) == ["upto=-1", "upto=0", "upto=1", "upto=2"]
    things = catalog(*items())
    repair_in_place(things, path)
    found = advance_snapshot(spark, path, state)
    assert rows(found, *SNAPSHOT_COLUMNS) == rows(ledger_snapshot(read_commits(spark, path)), *SNAPSHOT_COLUMNS)
    assert validation_problems(state_view(things, found)).filter("code = '2004'").count() == 0
    assert os.listdir(f"{state}/repairs=1") == ["upto=2"]
