import random
from functools import cmp_to_key

import pytest
from pyspark.sql import functions as F

from changeledger.functions.versions import in_family, is_valid_version, version_key, version_key_of
from changeledger.schema import LedgerError

EQUAL = [("1.2", "1.2.0"), ("1.2", "1.2.0.0"), ("1.0", "1"), ("01.2", "1.2"), ("1b", "1.B"), ("1-a_2", "1.A.2")]
LESS = [("1.2", "1.10"), ("2", "10"), ("1.2", "1.2.1"), ("20260812.1", "20260812.2"),
        ("20260812.2", "20260812.10"), ("20260327-b06.4", "20260327-b07.5"), ("20260327-b07.5", "20260328"),
        ("1.2", "1.a"), ("1.99999999999999999998", "1.99999999999999999999")]
INVALID = ["", " ", "1.", ".1", "1..2", "a", "-1", "1 2", "1,2", "v1", "1--b", "+1", "1.2\n", None]


def keys(spark, versions):
    df = spark.createDataFrame([(v,) for v in versions], "v string")
    return [r.k for r in df.select(version_key(F.col("v")).alias("k")).collect()]


def test_equal_and_less(spark):
    for a, b in zip(keys(spark, [a for a, _ in EQUAL]), keys(spark, [b for _, b in EQUAL])):
        assert a == b
    for a, b in zip(keys(spark, [a for a, _ in LESS]), keys(spark, [b for _, b in LESS])):
        assert a < b


def test_invalid(spark):
    assert keys(spark, INVALID) == [None] * len(INVALID)
    df = spark.createDataFrame([(v,) for v in INVALID], "v string")
    assert df.filter(is_valid_version(F.col("v"))).count() == 0
    for version in INVALID:
        with pytest.raises(LedgerError):
            version_key_of(version)


def test_family(spark):
    versions = ["20260327", "20260327-b06.4", "20260327.0", "202603270.1", "20260328"]
    df = spark.createDataFrame([(v,) for v in versions], "v string")
    hit = df.filter(in_family(version_key(F.col("v")), version_key_of("20260327.0")))
    assert [r.v for r in hit.collect()] == versions[:3]


def compare(a, b):
    """Token by token, missing tokens are zero; numbers by value and before words."""
    import re
    x, y = (re.findall("[0-9]+|[a-z]+", v.lower()) for v in (a, b))
    for i in range(max(len(x), len(y))):
        s, t = (p[i] if i < len(p) else "0" for p in (x, y))
        s, t = ((0, int(p), "") if p.isdigit() else (1, 0, p) for p in (s, t))
        if s != t:
            return -1 if s < t else 1
    return 0


def test_order_against_direct_comparison(spark):
    rnd = random.Random(7)
    parts = ["0", "00", "1", "01", "2", "10", "99", "100", "a", "B", "ab", "rc", "rc1", "12345678901234567890"]
    versions = [rnd.choice("0123456789") + "".join(
        rnd.choice(["", "."]) + rnd.choice(parts) if rnd.random() < 0.5 else rnd.choice("._-") + rnd.choice(parts)
        for _ in range(rnd.randint(0, 4))) for _ in range(1500)]
    found = keys(spark, versions)
    assert found == [version_key_of(v) for v in versions]
    pairs = list(zip(versions, found))
    by_rule = sorted(pairs, key=cmp_to_key(lambda p, q: compare(p[0], q[0])))
    assert [k for _, k in by_rule] == sorted(found)
    for (v, k), (w, m) in zip(by_rule, by_rule[1:]):
        assert (k == m) == (compare(v, w) == 0)


def test_key_comparison_reaches_the_scan(spark, tmp_path):
    df = spark.createDataFrame([(v,) for v in ("1.1", "1.2", "3")], "version string")
    df.withColumn("vsort", version_key(F.col("version"))).write.parquet(str(tmp_path / "c"))
    stored = spark.read.parquet(str(tmp_path / "c"))
    plan = stored.filter(F.col("vsort") >= version_key_of("1.2"))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(vsort), GreaterThanOrEqual(vsort," in plan


def test_numbers_of_any_length(spark):
    """The key of a column is that of a literal, and the order is that of the numbers."""
    digits = [1, 9, 10, 99, 9_999, 10_000, 123_456]
    values = [d * "1" for d in digits] + [d * "9" for d in digits] + ["0", "00", "0" * 20_000 + "1"]
    keys = {r.v: r.k for r in spark.createDataFrame([(v,) for v in values], "v string").select("v", version_key(F.col("v")).alias("k")).collect()}
    assert keys == {v: version_key_of(v) for v in values}
    number = {v: (len(v.lstrip("0")), v.lstrip("0")) for v in values}
    assert all((keys[a] < keys[b]) == (number[a] < number[b]) for a in values for b in values)
