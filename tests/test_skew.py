"""One target holds most rows; results stay exact and its rows are spread."""

import pytest
from pyspark.sql import Window, functions as F

from changeledger.operators import distribute
from changeledger.operators.distribute import lookup, number_rows
from changeledger.operators.history import repair
from changeledger.operators.pending import pending
from changeledger.operators.state import state_view
from conftest import rows


def hot(spark, n=20_000):
    return spark.range(n).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 50)).alias("target"),
        F.xxhash64("id").alias("place"), "id")


def test_number_rows(spark):
    df = hot(spark)
    found = number_rows(df, ["target"], [F.col("place")], "n")
    expected = df.withColumn("n", F.row_number().over(Window.partitionBy("target").orderBy("place")))
    assert found.count() == df.count()
    assert found.select("target", "id", "n").exceptAll(expected.select("target", "id", "n")).count() == 0


def test_number_rows_of_nothing(spark):
    assert number_rows(hot(spark).filter("id < 0"), ["target"], [F.col("place")], "n").count() == 0


def test_numbering_has_no_window_over_the_rows(spark):
    plan = number_rows(hot(spark), ["target"], [F.col("place")], "n")._jdf.queryExecution().optimizedPlan().toString()
    before_window = plan.split("Window")[1]
    assert "Aggregate [target" in before_window


@pytest.mark.parametrize("weight", [None, "n"])
@pytest.mark.parametrize("rows_per_copy", [100, 10 ** 6])
def test_lookup_is_exact(spark, monkeypatch, weight, rows_per_copy):
    monkeypatch.setattr(distribute, "ROWS_PER_COPY", rows_per_copy)
    df = hot(spark)
    facts = df.groupBy("target").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    joined = lookup(df, facts, ["target"], ["id"], weight=weight)
    assert joined.columns == ["target", "place", "id"] + (["n"] if not weight else []) + ["top"]
    expected = df.join(facts, "target").select("target", "id", "top")
    assert joined.select("target", "id", "top").exceptAll(expected).count() == 0
    assert joined.count() == df.count()
    cold = facts.filter("target <> 'hot'")
    for how, condition in (("left_anti", "target = 'hot'"), ("left_semi", "target <> 'hot'"),
                           ("inner", "target <> 'hot'")):
        found = lookup(df, cold, ["target"], ["id"], how, weight)
        assert found.count() == df.filter(condition).count()


def test_hot_key_is_dealt_evenly(spark, monkeypatch):
    monkeypatch.setattr(distribute, "ROWS_PER_COPY", 1000)
    df = hot(spark)
    facts = df.groupBy("target").agg(F.count("*").alias("n"))
    plan = lookup(df, facts, ["target"], ["id"], weight="n")._jdf.queryExecution().optimizedPlan().toString()
    assert "_copy" in plan.split("Join")[1]
    copies = F.pmod(F.xxhash64("id"), F.lit(14))
    sizes = [r["count"] for r in df.filter("target = 'hot'").groupBy(copies).count().collect()]
    assert len(sizes) == 14 and max(sizes) < 1200


def test_operators_with_hot_keys(monkeypatch, catalog, ledger):
    """Splitting every key changes nothing."""
    items = catalog(*[("hot", "V", f"{i}", i) for i in range(1, 40)], *[(f"t{i}", "V", "1", 1) for i in range(5)])
    records = ledger(*[("hot", i, "SQL", f"{1 + i % 20}", i % 7, True) for i in range(1, 80)])
    results = []
    for rows_per_copy in (10 ** 6, 3):
        monkeypatch.setattr(distribute, "ROWS_PER_COPY", rows_per_copy)
        results.append((rows(state_view(items, records), "target", "item_key", "state"),
                        rows(pending(items, records), "target", "script"),
                        rows(repair(items, records)[0], "target", "installed_rank", "checksum")))
    assert results[0] == results[1]
    assert [len(r) for r in results[0]] == [44, 24, 79]


def test_a_default_plan_reads_its_tables_few_times(spark):
    """Scans and shuffles of the whole plan, before equal shuffles are used again; more of them means that a part is
    planned once more."""
    from workload import spark_queries

    for name, scans, shuffles in (("plan_default", 12, 8), ("pending_all", 21, 11)):
        plan = spark_queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        found = plan.count("FileScan") + plan.count("Scan ExistingRDD"), plan.count("Exchange hashpartitioning")
        assert found[0] <= scans and found[1] <= shuffles, (name, found)
