import itertools
import random
import tracemalloc
import zlib

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from changeledger.functions import splitter
from changeledger.functions.arrays import sums_before
from changeledger.functions.checksum import script_checksum
from changeledger.functions.placeholders import substitute, undefined_placeholders
from changeledger.functions.redact import redact
from changeledger.functions.splitter import (
    Dialect, MYSQL, ORACLE, POSTGRESQL, split_statements, split_text, with_batches)
from changeledger.operators.statements import failing_statements, write_in_order


# ------------------------------------------------------------------ checksum

def expected_crc(data):
    data = data.removeprefix(b"\xef\xbb\xbf").replace(b"\r\n", b"\n").replace(b"\r", b"\n")
    crc = zlib.crc32(data)
    return crc - 2 ** 32 if crc >= 2 ** 31 else crc


def test_checksum(spark):
    samples = [b"", b"a\r\nb", b"a\nb", b"a\rb", b"\xef\xbb\xbfa\nb", "建表\n".encode(), bytes(range(256)),
               b"\r\r\n\n", b"\xef\xbb\xbf\xef\xbb\xbf", b"INSERT INTO t VALUES (1);\r\nINSERT INTO t VALUES (2);\r"]
    rnd = random.Random(3)
    samples += [bytes(rnd.choice(b"\r\n\xef\xbb\xbfab") for _ in range(rnd.randint(0, 30))) for _ in range(300)]
    df = spark.createDataFrame([(i, bytearray(s)) for i, s in enumerate(samples)], "i int, c binary")
    found = [r.x for r in df.select("i", script_checksum(F.col("c")).alias("x")).orderBy("i").collect()]
    assert found == [expected_crc(s) for s in samples]
    assert found[9] == 1151700373 and min(found) < 0


# -------------------------------------------------------------- placeholders

VALUES = {"foo": "REPLACED", "schema": "mytable", "nest": "${foo}", "a\\b": "x"}
BUILTINS = {"schema": "public", "user": "root"}


def literal_map(values):
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def replaced(spark, text, **marks):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(substitute(F.col("t"), literal_map(VALUES), literal_map(BUILTINS), **marks)).first()[0]


@pytest.mark.parametrize("text,result", [
    ("$${foo} = ${foo}", "${foo} = REPLACED"), ("$${undefined}", "${undefined}"),
    ("${ledger:schema}.${ledger:user} ${schema}", "public.root mytable"), ("SELECT ${oops", "SELECT ${oops"),
    ("$$${foo}", "$${foo}"), ("${nest}", "${foo}"), ("${nope} ${foo}", "${nope} REPLACED"), ("", ""),
    ("a $ b {c} $", "a $ b {c} $"), ("${ledger:foo}", "${ledger:foo}"), ("${a\\b}\n${\nfoo}", "x\n${\nfoo}")])
def test_substitute(spark, text, result):
    assert replaced(spark, text) == result


def test_other_marks(spark):
    assert replaced(spark, "$#[foo] = #[foo]", prefix="#[", suffix="]") == "#[foo] = REPLACED"
    assert replaced(spark, "%foo% %x %foo", prefix="%", suffix="%") == "REPLACED %x %foo"
    assert replaced(spark, "@{other:user}", prefix="@{", namespace="other:") == "root"


def test_undefined(spark):
    df = spark.createDataFrame([("a ${x}\n$${y} ${foo}\n\n${z}${ledger:foo} ${open",)], "t string")
    found = df.select(F.inline(undefined_placeholders(F.col("t"), literal_map(VALUES), literal_map(BUILTINS))))
    assert [tuple(r) for r in found.collect()] == [("x", 1), ("z", 4), ("ledger:foo", 4)]


def test_redact(spark):
    text = "jdbc:x://me:secret@host password= hunter2 PASSWORD:abc; tok123"
    df = spark.createDataFrame([(text,)], "t string").select(redact(F.col("t"), secret="tok123"))
    assert df.first()[0] == "jdbc:x://me:****@host password= **** PASSWORD:**** ****"


# ------------------------------------------------------------------ splitter

def split(spark, text, dialect=POSTGRESQL):
    df = spark.createDataFrame([("s", text)], "script string, text string")
    found = split_statements(df, dialect).orderBy("stmt_no").collect()
    assert [r.stmt_no for r in found] == list(range(1, len(found) + 1))
    return [(r.line, r.sql) for r in found]


GOLDEN = [
    (POSTGRESQL, "SELECT 1;\nSELECT 2;\n", [(1, "SELECT 1"), (2, "SELECT 2")]),
    (POSTGRESQL, "SELECT 1;\r\nSELECT 2;\r\n", [(1, "SELECT 1"), (2, "SELECT 2")]),
    (POSTGRESQL, "SELECT 1;\rSELECT 2;", [(1, "SELECT 1"), (2, "SELECT 2")]),
    (POSTGRESQL, "CREATE TABLE t (id INT);\nINSERT INTO t VALUES (1)\n",
     [(1, "CREATE TABLE t (id INT)"), (2, "INSERT INTO t VALUES (1)")]),
    (POSTGRESQL, "-- line comment\n/* block\n   lines; */\nSELECT /*+ INDEX(t) */ 1;\nSELECT 2;",
     [(4, "-- line comment\n/* block\n   lines; */\nSELECT /*+ INDEX(t) */ 1"), (5, "SELECT 2")]),
    (POSTGRESQL, "INSERT INTO t VALUES ('it''s; ok');\nINSERT INTO t VALUES ('line\nbreak');\nX;",
     [(1, "INSERT INTO t VALUES ('it''s; ok')"), (2, "INSERT INTO t VALUES ('line\nbreak')"), (4, "X")]),
    (POSTGRESQL, "F AS $$\nA;\nB;\n$$ L;\nSELECT $1;", [(1, "F AS $$\nA;\nB;\n$$ L"), (5, "SELECT $1")]),
    (POSTGRESQL, "F AS $body$\n 'has $$ and ; inside';\n$body$ L;", [(1, "F AS $body$\n 'has $$ and ; inside';\n$body$ L")]),
    (POSTGRESQL, "-- 中文;\nSELECT '日本;';", [(2, "-- 中文;\nSELECT '日本;'")]),
    (POSTGRESQL, "", []), (POSTGRESQL, "  \n\t\n ", []), (POSTGRESQL, "-- c\n/* b */\n", []),
    (POSTGRESQL, "-- c\n;\n", []), (POSTGRESQL, ";;;SELECT 1;;;SELECT 2;;;", [(1, "SELECT 1"), (1, "SELECT 2")]),
    (POSTGRESQL, "\n\n   SELECT 1;", [(3, "SELECT 1")]), (POSTGRESQL, "SELECT $abc;", [(1, "SELECT $abc")]),
    (POSTGRESQL, "SELECT 1; /* unfinished", [(1, "SELECT 1")]), (POSTGRESQL, "SELECT 'open;", [(1, "SELECT 'open;")]),
    (POSTGRESQL, 'SELECT "a;""b";x', [(1, 'SELECT "a;""b"'), (1, "x")]),
    (Dialect(separator="GO"), "a; b GO c", [(1, "a; b"), (1, "c")]),
    (MYSQL, "# hash; comment\nSELECT 1;\nSELECT 2; # trailing", [(2, "# hash; comment\nSELECT 1"), (3, "SELECT 2")]),
    (MYSQL, "INSERT ('it\\'s; ok');\nSELECT `a;``b`;", [(1, "INSERT ('it\\'s; ok')"), (2, "SELECT `a;``b`")]),
    (MYSQL, "DROP P;\nDELIMITER //\nCREATE P\nBEGIN\n  SELECT 1;\nEND//\ndelimiter ;\nSELECT 3;\n",
     [(1, "DROP P"), (3, "CREATE P\nBEGIN\n  SELECT 1;\nEND"), (8, "SELECT 3")]),
    (MYSQL, "DELIMITER //", []), (MYSQL, "SELECT 'abc\\", [(1, "SELECT 'abc\\")]),
    (MYSQL, "SELECT 1 -- DELIMITER //\n;SELECT 2", [(1, "SELECT 1 -- DELIMITER //"), (2, "SELECT 2")]),
    (MYSQL, "DELIMITER 'x", [(1, "DELIMITER 'x")]),
    (ORACLE, "CREATE OR REPLACE PROCEDURE g AS\nBEGIN\n  x('a');\nEND;\n/\nSELECT 1 FROM dual;",
     [(1, "CREATE OR REPLACE PROCEDURE g AS\nBEGIN\n  x('a');\nEND;"), (6, "SELECT 1 FROM dual")]),
    (ORACLE, "CREATE OR REPLACE EDITIONABLE TRIGGER t\nBEGIN\n  x;\nEND;\n/\nSELECT 1",
     [(1, "CREATE OR REPLACE EDITIONABLE TRIGGER t\nBEGIN\n  x;\nEND;"), (6, "SELECT 1")]),
    (ORACLE, "DECLARE\n  v INT := 0;\nBEGIN\n  v := 1;\nEND;\n/", [(1, "DECLARE\n  v INT := 0;\nBEGIN\n  v := 1;\nEND;")]),
    (ORACLE, "/* two\n lines */ begin a; end;\n/\nCREATE VIEW v AS x;\ny;",
     [(2, "/* two\n lines */ begin a; end;"), (4, "CREATE VIEW v AS x"), (5, "y")]),
    (ORACLE, "BEGIN a; '\n/\n'; -- x\n/\nz", [(1, "BEGIN a; '\n/\n'; -- x"), (5, "z")]),
]


@pytest.mark.parametrize("dialect,text,expected", GOLDEN)
def test_split(spark, dialect, text, expected):
    assert split(spark, text, dialect) == expected
    assert list(split_text(text, dialect)) == expected


ATOMS = ["a", "b ", "'", '"', ";", "--", "/*", "*/", "/*/", "\n", "\r\n", "\r", "$$", "$x$", "$1", " ", "/",
         "-", "*", "$", "''", "é", "\t", "#"]


def test_both_splitters_agree(spark):
    rnd = random.Random(11)
    texts = ["".join(rnd.choice(ATOMS) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for dialect in (POSTGRESQL, Dialect(hash_comments=True, identifier_quote="`"), Dialect(separator="-;")):
        found = {i: [] for i in range(len(texts))}
        for r in split_statements(df, dialect).orderBy("i", "stmt_no").collect():
            found[r.i].append((r.line, r.sql))
        for i, text in enumerate(texts):
            assert found[i] == list(split_text(text, dialect)), repr(text)


@pytest.mark.parametrize("dialect", [MYSQL, ORACLE])
def test_scanned_scripts_in_several_lots(spark, monkeypatch, dialect):
    monkeypatch.setattr(splitter, "TOGETHER", 25)
    texts = [None, "", "a;\nb;", "x" * 90 + ";y", None, "-- no code", "BEGIN c; d;\n/\n", "DELIMITER //\ne; f//"] * 6
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    found = {i: [] for i in range(len(texts))}
    for r in split_statements(df, dialect).orderBy("i", "stmt_no").collect():
        found[r.i].append((r.stmt_no, r.line, r.sql))
    assert found == {i: [(n, *s) for n, s in enumerate(split_text(t or "", dialect), 1)] for i, t in enumerate(texts)}
    kept = df.select("i", splitter.statements_of(F.col("text"), dialect).isNull().alias("none")).collect()
    assert [r.none for r in sorted(kept)] == [t is None for t in texts]


def test_memory_of_a_task_does_not_grow_with_its_batches(monkeypatch):
    """The statements of a batch of scripts are never held together."""
    monkeypatch.setattr(splitter, "TOGETHER", 1 << 13)

    def peak(scripts):
        texts = pa.array(["SELECT 1;\nSELECT 'a;b';\n" * 20] * scripts)
        tracemalloc.start()
        rows = sum(map(len, splitter._statement_arrays(iter([texts]), MYSQL)))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows == scripts
        return most

    assert peak(20) > 0 and peak(1000) < 2 * peak(100)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["SELECT 1", "x", "'a;b'", "-- c;\n y", "$$;$$", "/* ; */ z"]), max_size=8))
def test_joined_statements_come_apart_again(statements):
    assert [sql for _, sql in split_text(" ;\n".join(statements), POSTGRESQL)] == [s.strip() for s in statements]


def test_large_script(spark):
    text = "SELECT '" + "x''" * 200_000 + "';\n" + "a /* ; */ = 'b;';\n" * 20_000
    found = split(spark, text)
    assert len(found) == 20_001 and found[-1] == (20_001, "a /* ; */ = 'b;'")


def test_sums_before(spark):
    rnd = random.Random(5)
    lists = [[rnd.randint(0, 5) for _ in range(n)] for n in (0, 1, 2, 3, 4, 5, 9, 10, 50, 101)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, v array<int>")
    found = [r.s for r in df.select("i", sums_before(F.col("v")).alias("s")).orderBy("i").collect()]
    assert found == [[sum(v[:i]) for i in range(len(v))] for v in lists]


def test_batches_and_failures(spark):
    statements = spark.createDataFrame([(t, "s", n, n * 10) for t in "abcd" for n in range(1, 8)], "target string, script string, stmt_no int, line int")
    batches = with_batches(statements.filter("target = 'a'"), 3).orderBy("stmt_no").collect()
    assert [r.batch_no for r in batches] == [0, 0, 0, 1, 1, 1, 2]
    schema = "target string, script string, success boolean, batch_no int, applied_in_batch int"
    outcomes = spark.createDataFrame(
        [("a", "s", False, 1, 1), ("b", "s", False, 0, 3), ("c", "s", False, 2, 1), ("d", "s", True, 0, 0)], schema)
    found = {r.target: (r.stmt_no, r.line) for r in failing_statements(statements, outcomes, 3).collect()}
    assert found == {"a": (5, 50), "b": (4, 30), "c": (8, 70)}
    one = spark.createDataFrame([("a", "s", False, 4, 0)], schema)
    assert [(r.code, r.stmt_no, r.line) for r in failing_statements(statements, one).collect()] == [("2010", 5, 50)]


def test_failures_of_one_name_in_two_targets(spark):
    statements = spark.createDataFrame([("a", "s", 1, 1), ("a", "s", 2, 2), ("b", "s", 1, 1), ("b", "s", 2, 4), ("b", "s", 3, 9)],
                                       "target string, script string, stmt_no int, line int")
    outcomes = spark.createDataFrame([("a", "s", False, 1, 0), ("b", "s", False, 1, 0)],
                                     "target string, script string, success boolean, batch_no int, applied_in_batch int")
    found = sorted((r.target, r.stmt_no, r.line) for r in failing_statements(statements, outcomes).collect())
    assert found == [("a", 2, 2), ("b", 2, 4)]


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 255, 256, 4095, 4096, 4097, 70_001])
def test_sums_before_at_all_sizes(spark, n):
    values = [(i * 7) % 11 for i in range(n)]
    frame = spark.createDataFrame([(values,)], "v array<int>")
    want = [sum(values[:i]) for i in range(n)] if n < 300 else list(itertools.accumulate(values, initial=0))[:n]
    assert list(frame.select(sums_before(F.col("v")).alias("s")).first()["s"]) == want


def test_a_dry_run_written_in_order(spark, tmp_path):
    """Files read by name are the plan in order: several targets in a file, a large target over several."""
    r = random.Random(3)
    rows_ = [(t, (False, "", f"v{i:05}"), f"s{i}", n, "x") for t, size in [("a", 3), ("hot", 900), ("m", 2), ("z", 5)]
             for i in range(size) for n in (1, 2, 3)]
    r.shuffle(rows_)
    frame = spark.createDataFrame(rows_, "target string, run_order struct<repeatable:boolean,directory:string,version:string>, script string, stmt_no int, sql string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_in_order(frame.repartition(6), str(tmp_path / "plan"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "plan").glob("part-*.parquet"))
    parts = [[(r.target, tuple(r.run_order), r.stmt_no) for r in spark.read.parquet(str(f)).coalesce(1).collect()] for f in files]
    assert [x for part in parts for x in part] == sorted((t, o, n) for t, o, _, n, _ in rows_)
    hot = [i for i, part in enumerate(parts) if any(x[0] == "hot" for x in part)]
    assert len(hot) > 1 and any(len({x[0] for x in part}) > 1 for part in parts)
