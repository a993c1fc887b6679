import pytest
from pyspark.sql import functions as F

from changeledger.functions.paths import (
    Naming, PathFilter, directory_version, file_name_of, parent_of, version_group)
from changeledger.operators.catalog import build_catalog, classify, duplicate_versions
from changeledger.schema import LedgerError
from conftest import rows

PATHS = ["V1__a.sql", "20230531/V1__a.sql", "a/20230531/V2__b.sql", "a/b/R__v.sql", "20230531x/V3__c.sql"]


def frame(spark, paths):
    return spark.createDataFrame([(p,) for p in paths], "script string")


def matching(spark, **arguments):
    df = frame(spark, PATHS).filter(PathFilter(**arguments).matches(F.col("script")))
    return [r.script for r in df.collect()]


def test_path_filter(spark):
    assert matching(spark) == PATHS
    assert matching(spark, directory_glob="20230531*", file_glob="V*.sql") == [PATHS[1], PATHS[4]]
    assert matching(spark, directory_glob="**/20230531") == PATHS[1:3]
    assert matching(spark, directory_regex=r"(.*/)?\d+", file_regex=r"V[12]__.*") == PATHS[1:3]
    assert matching(spark, path_glob="a/**") == PATHS[2:4]
    assert matching(spark, directory_glob="a/**") == PATHS[2:4]
    assert matching(spark, directory_glob="a/b/**") == [PATHS[3]]
    assert matching(spark, path_glob="*") == [PATHS[0]]
    assert matching(spark, path_glob="**.sql", file_glob="V?__a.sql") == PATHS[:2]
    assert matching(spark, file_glob="V1__a?sql") == PATHS[:2]
    assert matching(spark, file_glob="V1__a.sq") == []


def test_glob_and_regex_exclude_each_other():
    with pytest.raises(LedgerError):
        PathFilter(file_glob="*", file_regex=".*")


def test_directory_version(spark):
    paths = ["1.2/V1.2.3__a.sql", "1/x/2.0/V2__a.sql", "V1__a.sql", "v1/V1__a.sql", "1a/V1__a.sql"]
    df = frame(spark, paths).select(directory_version(F.col("script")).alias("d"))
    assert [r.d for r in df.collect()] == ["1.2", "2.0", None, None, None]
    named = r"(rel|r)-(?<version>[0-9.]+)"
    df = frame(spark, ["r-1/rel-2/V2__a.sql", "x/V1__a.sql"]).select(
        directory_version(F.col("script"), named).alias("d"))
    assert [r.d for r in df.collect()] == ["2", None]
    assert version_group(named) == 2 and version_group(r"(?:x)(?<=a)[(](\d)") == 1
    for bad in ("", "  ", r"\d+", r"(?:\d+)"):
        with pytest.raises(LedgerError):
            version_group(bad)


def test_parent_and_name(spark):
    df = frame(spark, ["a/b/c.sql", "c.sql"]).select(
        parent_of(F.col("script")).alias("p"), file_name_of(F.col("script")).alias("n"))
    assert [tuple(r) for r in df.collect()] == [("a/b", "c.sql"), ("", "c.sql")]


def test_classify(spark):
    expected = {
        "V1.2__add_x.sql": ("SQL", "1.2", "add_x"),
        "d/U20260327-b06.4__undo.sql": ("UNDO_SQL", "20260327-b06.4", "undo"),
        "R__view.sql": ("REPEATABLE", None, "view"),
        "V1_2__a__b.sql": ("SQL", "1_2", "a__b"),
        "R1__view.sql": ("2005", None, None),
        "V__x.sql": ("2001", None, None),
        "V1._x.sql": ("2001", None, None),
        "Vabc__x.sql": ("2001", None, None),
        "U1.sql": ("2001", None, None),
        "beforeMigrate.sql": ("CALLBACK", None, None),
        "d/beforeMigrate.sql": ("IGNORED", None, None),
        "note.sql": ("IGNORED", None, None),
        "V1__x.txt": ("IGNORED", None, None),
        "v1__x.sql": ("IGNORED", None, None),
    }
    found = {r.script: (r.kind, r.version, r.description) for r in classify(frame(spark, list(expected))).collect()}
    assert found == expected
    other = Naming(versioned="M.", separator="--", suffix=".ddl")
    found = classify(frame(spark, ["M.1.5--x.ddl", "R--y.ddl"]), other).collect()
    assert [(r.kind, r.version, r.description) for r in found] == [("SQL", "1.5", "x"), ("REPEATABLE", None, "y")]


def test_build_catalog(spark):
    names = ["1/V1.1__a.sql", "1/V2__b.sql", "x/V1.2__c.sql", "R__r.sql", "1/R1__old.sql", "1/Vx.sql",
             "1/U1.1__a.sql", "1/V1.01__again.sql", "1/U1.1.0__again.sql", "afterMigrate.sql"]
    df = spark.createDataFrame([("t", n, bytearray(b"x\r\n")) for n in names],
                               "target string, script string, content binary")
    items, problems = build_catalog(df, directory_versions=True)
    assert rows(items, "script", "kind", "dir_version") == [
        ("1/U1.1.0__again.sql", "UNDO_SQL", "1"), ("1/U1.1__a.sql", "UNDO_SQL", "1"),
        ("1/V1.01__again.sql", "SQL", "1"), ("1/V1.1__a.sql", "SQL", "1"), ("R__r.sql", "REPEATABLE", None)]
    assert rows(problems, "code", "script", "detail") == [
        ("2001", "1/V2__b.sql", "2 is not in directory version 1"),
        ("2001", "1/Vx.sql", "file name cannot be read"),
        ("2001", "x/V1.2__c.sql", "no version in the directory"),
        ("2002", "1/U1.1__a.sql", "1/U1.1.0__again.sql"), ("2002", "1/V1.1__a.sql", "1/V1.01__again.sql"),
        ("2005", "1/R1__old.sql", "numbered repeatable")]
    items, problems = build_catalog(df, PathFilter(directory_glob="x"))
    assert rows(items, "script", "dir_version") == [("x/V1.2__c.sql", None)] and problems.count() == 0


def test_many_copies_of_one_version(spark):
    df = spark.range(3000).select(
        F.lit("t").alias("target"), F.concat(F.lit("V1."), F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(0),
                                             F.lit("__"), F.col("id"), F.lit(".sql")).alias("script"))
    found = duplicate_versions(classify(df).withColumn("checksum", F.lit(0)))
    assert found.count() == 999 and found.select("detail").distinct().count() == 1
