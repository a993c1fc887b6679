import os

import pytest
from pyspark.sql import functions as F

from changeledger.operators.catalog import build_catalog
from changeledger.operators.frames import prepare_catalog, prepare_ledger
from changeledger.operators.state import state_view
from changeledger.operators.suggest import nearest_key
from changeledger.plans.commands import Reconciler
from changeledger.schema import LEDGER_SCHEMA, LedgerError
from changeledger.sources.ledgers import (
    append_records, create_ledger_table, in_rank_order, read_ledger, save_bucketed, write_snapshot)
from changeledger.functions.paths import PathFilter
from changeledger.sources.scripts import first_location, list_scripts, read_contents, read_scripts, script_text
from conftest import rows


@pytest.fixture
def folders(tmp_path):
    files = {"one/1.0/V1.0.1__a b.sql": b"\xef\xbb\xbfSELECT 1;\r\n", "one/R__v.sql": b"first",
             "one/note.txt": b"x", "two/R__v.sql": b"second", "two/deep/er/V2__b.sql": b"\xe4\xb8\xad"}
    for name, content in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return [f"filesystem:{tmp_path}/one", f"filesystem:{tmp_path}/two/"]


def test_read_scripts(spark, folders):
    scripts = read_scripts(spark, folders)
    assert rows(scripts, "location_no", "script") == [
        (0, "1.0/V1.0.1__a b.sql"), (0, "R__v.sql"), (1, "R__v.sql"), (1, "deep/er/V2__b.sql")]
    once = first_location(scripts)
    assert rows(once.select("script", script_text(F.col("content")).alias("text")), "script", "text") == [
        ("1.0/V1.0.1__a b.sql", "﻿SELECT 1;\r\n"), ("R__v.sql", "first"), ("deep/er/V2__b.sql", "中")]
    items, problems = build_catalog(once.withColumn("target", F.lit("t")))
    assert rows(items, "script", "kind", "version") == [
        ("1.0/V1.0.1__a b.sql", "SQL", "1.0.1"), ("R__v.sql", "REPEATABLE", None), ("deep/er/V2__b.sql", "SQL", "2")]
    assert problems.count() == 0
    paths_only = scripts.select("script")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in paths_only.split("BinaryFile")[-1].split("ReadSchema")[-1]


def test_only_chosen_files_are_opened(spark, folders, tmp_path):
    """A listing opens no file; contents come from the files that path filter and order of locations leave."""
    (tmp_path / "two" / "a[1] +%20.sql").write_bytes(b"odd name")
    listing = list_scripts(spark, folders)
    assert rows(listing, "location_no", "script", "length") == [
        (0, "1.0/V1.0.1__a b.sql", 14), (0, "R__v.sql", 5), (1, "R__v.sql", 6), (1, "a[1] +%20.sql", 8), (1, "deep/er/V2__b.sql", 3)]
    scan = listing._jdf.queryExecution().executedPlan().toString()
    assert "content" not in scan.split("BinaryFile")[-1].split("ReadSchema")[-1]
    chosen = first_location(listing.filter(PathFilter(path_regex=r"[^V]*R__v\.sql|.*%20\.sql").matches(F.col("script"))))
    found = read_contents(chosen.withColumn("target", F.lit("t")))
    assert rows(found.select("target", "script", script_text(F.col("content")).alias("text")), "target", "script", "text") == [
        ("t", "R__v.sql", "first"), ("t", "a[1] +%20.sql", "odd name")]
    whole = first_location(read_scripts(spark, folders)).filter(PathFilter(path_regex=r"[^V]*R__v\.sql|.*%20\.sql").matches(F.col("script")))
    assert rows(whole, "script", "content") == rows(found, "script", "content")
    assert _files_read(found) == 2
    assert read_contents(listing.limit(0)).collect() == []


def _files_read(frame) -> int:
    """Files that the scan with contents lists, from the metrics of its plan."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    found, todo = [], [plan.executedPlan() if "executedPlan" in dir(plan) else plan]
    while todo:
        node = todo.pop()
        if "content" in node.toString().split("\n")[0] and node.nodeName().startswith("Scan"):
            found.append(node.metrics().apply("numFiles").value())
        for call in ("plan", "executedPlan"):
            if call in dir(node):
                todo.append(getattr(node, call)())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return sum(found)


def test_locations_above_the_root(spark):
    with pytest.raises(LedgerError):
        list_scripts(spark, ["filesystem:/../../tmp"])


def test_roots_are_qualified(spark, tmp_path, monkeypatch):
    """Relative, dotted and URI roots, one whose name ends an earlier folder, and signs that mean patterns."""
    root = tmp_path / "mysql" / "project" / "sql"
    for folder in (root, tmp_path / "a b[1]{x}*"):
        (folder / "d").mkdir(parents=True)
        (folder / "d" / "V1__a.sql").write_text("x")
    monkeypatch.chdir(tmp_path)
    here = [f"{root}", f"{root}/", f"file://{root}", f"file:{root}", f"{root}/../sql", f"{root}/./d/..", f"{tmp_path}/a b[1]{{x}}*"]
    for location in here:
        assert rows(read_scripts(spark, [f"filesystem:{location}"]), "script") == [("d/V1__a.sql",)], location
    working = spark._jvm.java.lang.System.getProperty("user.dir")
    relative = os.path.relpath(root, working)
    assert rows(read_scripts(spark, [f"filesystem:{relative}"]), "script") == [("d/V1__a.sql",)]


def test_one_path_in_two_locations(spark, folders):
    scripts = read_scripts(spark, folders).withColumn("target", F.lit("t"))
    items, problems = build_catalog(scripts)
    assert rows(problems, "code", "script", "detail") == [("2002", "R__v.sql", "R__v.sql in location 0")]
    twice = build_catalog(read_scripts(spark, [folders[0], folders[0]]).withColumn("target", F.lit("t")).drop("location_no"))[1]
    assert twice.count() == 2


def test_a_target_with_a_duplicate_plans_nothing(spark, ledger):
    names = [("bad", "V1__a.sql"), ("bad", "V1.0__b.sql"), ("bad", "U1__a.sql"), ("good", "V1__a.sql"), ("good", "R__r.sql")]
    scripts = spark.createDataFrame([(t, n, bytearray(b"x")) for t, n in names], "target string, script string, content binary")
    items, problems = build_catalog(scripts)
    known = ledger(("bad", 1, "SQL", "0", 1, True))
    nameless = known.withColumn("target", F.lit(None).cast("string"))
    run = Reconciler(items, known.unionByName(nameless), catalog_problems=problems, validate_first=False)
    assert rows(run.plan(), "target", "script") == [("good", "R__r.sql"), ("good", "V1__a.sql")]
    assert rows(run.plan_problems(), "target", "code") == [("bad", "2002"), (None, "4002")]
    texts = spark.createDataFrame([("good", "V1__a.sql", "select 1;")], "target string, script string, text string")
    statements, found = run.dry_run(texts)
    assert rows(statements, "target", "sql") == [("good", "select 1")]
    assert rows(found, "target", "code", "script") == [("good", "2010", "R__r.sql")]


def test_bad_locations(spark, tmp_path):
    for location, code in [(f"filesystem:{tmp_path}/none", "4005"), (f"classpath:{tmp_path}", "4002")]:
        with pytest.raises(LedgerError) as error:
            read_scripts(spark, [location])
        assert error.value.code == code
    with pytest.raises(LedgerError):
        read_scripts(spark, [])


def test_ledger_files(spark, ledger, tmp_path):
    path = str(tmp_path / "ledger")
    empty = read_ledger(spark, path=path)
    assert empty.count() == 0 and empty.columns == LEDGER_SCHEMA.fieldNames()
    append_records(ledger(("t", 2, "SQL", "2", 1, True)), path=path)
    append_records(ledger(("t", 1, "SQL", "1", 1, True)), path=path)
    stored = read_ledger(spark, path=path)
    assert [r.installed_rank for r in in_rank_order(stored).collect()] == [1, 2]
    write_snapshot(stored, f"{path}2")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        write_snapshot(stored, f"{path}2")


def test_ledger_table(spark, ledger):
    assert read_ledger(spark, table="ledger_t").count() == 0
    create_ledger_table(spark, "ledger_t")
    create_ledger_table(spark, "ledger_t")
    append_records(ledger(("t", 1, "SQL", "1", 1, True)), table="ledger_t")
    assert rows(read_ledger(spark, table="ledger_t"), "target", "version", "success") == [("t", "1", True)]


def test_bucketed_tables_meet_without_shuffle(spark, catalog, ledger):
    save_bucketed(prepare_catalog(catalog(("t", "V", "1", 1), ("t", "V", "2", 1))), "bucketed_catalog", 4)
    save_bucketed(prepare_ledger(ledger(("t", 1, "SQL", "1", 1, True))), "bucketed_ledger", 4)
    view = state_view(spark.table("bucketed_catalog"), spark.table("bucketed_ledger"))
    assert rows(view, "state") == [("PENDING",), ("SUCCESS",)]
    plan = view._jdf.queryExecution().executedPlan().toString()
    assert "item_key" not in "".join(line for line in plan.splitlines() if "Exchange hashpartitioning" in line)


def test_nearest_key(spark):
    known = ["url", "user", "locations", "table", "tables"]
    words = ["locatoins", "location", "usr", "tableq", "tabl", "tablx", "completely.else", "url", "usr"]
    found = nearest_key(spark.createDataFrame([(w,) for w in words], "key string"), known)
    assert {r.key: r.suggestion for r in found.collect()} == {
        "locatoins": "locations", "location": "locations", "usr": "user", "tableq": "table", "tabl": "table", "tablx": "table",
        "completely.else": None}
