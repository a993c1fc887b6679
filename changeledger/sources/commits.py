"""A ledger in a folder of commits: appends that can be repeated, repair of the parts that need it, snapshots.

Below the folder lie ``commit=<number>/run=<id>/part=<part of the targets>/*.parquet``.  A commit is staged in a
folder that readers pass over and becomes visible by one rename, which fails if its number is taken.
"""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from changeledger.operators.distribute import fixed
from changeledger.operators.history import checksum_updates, repair_report, repaired
from changeledger.operators.snapshot import ledger_snapshot, merge_snapshots
from changeledger.schema import BAD_SETTING, CONFLICT, LEDGER_COLUMNS, LEDGER_SCHEMA, PROBLEM_COLUMNS, LedgerError

PARTITIONS = ["commit", "run", "part"]
STORED_SCHEMA = T.StructType([*LEDGER_SCHEMA.fields, T.StructField("commit", T.IntegerType()),
                              T.StructField("run", T.StringType()), T.StructField("part", T.IntegerType())])
_RUN = re.compile(r"[A-Za-z0-9][A-Za-z0-9.-]*")


class _Folder:
    """File names below a folder, through the file system that Spark uses."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.path = path.rstrip("/")
        self.system = self._path("").getFileSystem(self.conf)

    def _path(self, below: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{below}" if below else self.path)

    def names(self, pattern: str) -> list[str]:
        found = self.system.globStatus(self._path(pattern))
        return sorted(f.getPath().getName() for f in found or [])

    def delete(self, below: str) -> None:
        self.system.delete(self._path(below), True)

    def touch(self, below: str) -> None:
        self.system.create(self._path(below), False).close()

    def publish(self, source: str, name: str) -> bool:
        """Rename a folder; False if the new name is taken."""
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.system.getUri(), self.conf)
        options = self.jvm.java.lang.reflect.Array.newInstance(
            self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            files.rename(self._path(source), self._path(name), options)
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" in str(error.java_exception.getClass()):
                return False
            raise
        return True


def _numbers(folder: _Folder, pattern: str) -> list[int]:
    return [int(name.partition("=")[2]) for name in folder.names(pattern)]


def last_commit(spark: SparkSession, path: str) -> int:
    """The number of the newest commit; -1 where there is none."""
    return max(_numbers(_Folder(spark, path), "commit=*"), default=-1)


def read_commits(spark: SparkSession, path: str, after: int = -1, upto: int | None = None) -> DataFrame:
    """Records with commit, run and part, of the commits after one and up to another.

    The numbers of commits are in folder names: files of other commits are not opened.  A folder that does
    not exist yet has no records.
    """
    folder = _Folder(spark, path)
    if not folder.names("commit=*"):
        return spark.createDataFrame([], STORED_SCHEMA)
    rows = spark.read.schema(STORED_SCHEMA).parquet(folder.path)
    if after >= 0:
        rows = rows.filter(F.col("commit") > after)
    return rows if upto is None else rows.filter(F.col("commit") <= upto)


def part_of(target: Column, parts: int) -> Column:
    """The part of the targets that a target belongs to; 0 where there is no target."""
    return F.coalesce(F.pmod(F.crc32(target.cast("binary")), F.lit(parts)).cast("int"), F.lit(0))


def append_run(records: DataFrame, path: str, run: str, since: int, parts: int = 64) -> DataFrame:
    """Append the records of a run, and return conflicts as problem rows.

    ``run``: the run's own id; a run that is there already adds nothing.  ``since``: ``last_commit`` when the run
    was planned.  A target to which a later commit has added records since then gets a 3001 row instead of
    its records, whose ranks would be taken; the records of other targets are appended.  Two runs cannot get the
    same commit number: the later one compares again with what the earlier one added.  Only commits
    after ``since`` are read.  Within a run ranks are given once, so a ledger has no rank twice.
    """
    if not _RUN.fullmatch(run):
        raise LedgerError(BAD_SETTING, f"run id needs letters, digits, dots and dashes: {run!r}")
    spark, folder = records.sparkSession, _Folder(records.sparkSession, path)
    conflicts = spark.createDataFrame([], "target string, code string, script string, detail string")
    left = fixed(records.select(*LEDGER_COLUMNS))
    while not folder.names(f"commit=*/run={run}"):
        last = last_commit(spark, path)
        taken = (read_commits(spark, path, since, last).groupBy("target").agg(F.min("commit").alias("commit"))
                 .join(left.select("target").distinct(), "target", "left_semi"))
        lost = fixed(taken.select("target", F.lit(CONFLICT).alias("code"), F.lit("").alias("script"), F.concat(
            F.lit("records added by commit "), F.col("commit").cast("string")).alias("detail")))
        conflicts = conflicts.unionByName(lost)
        left = left.join(lost.select("target"), "target", "left_anti")
        staged = f"_staged-{run}-{uuid.uuid4().hex}"
        (left.withColumn("run", F.lit(run)).withColumn("part", part_of(F.col("target"), parts))
         .repartition("part", F.pmod(F.xxhash64("target", "installed_rank"), F.lit(8))).sortWithinPartitions("target", "installed_rank")
         .write.partitionBy("run", "part").parquet(f"{folder.path}/{staged}"))
        if not folder.names(f"{staged}/run=*"):
            folder.delete(staged)
            break
        if folder.publish(staged, f"commit={last + 1}"):
            break
        folder.delete(staged)
        since = last
    return conflicts.select(*PROBLEM_COLUMNS)


def repair_in_place(catalog: DataFrame, path: str) -> DataFrame:
    """``repair`` for a ledger of commits: only partitions with a record that changes are read whole and written.

    Returns the report of ``repair``.  What is wrong is found from the columns that say so.  The changed partitions
    are written beside the old ones and then put in their place, one by one; a partition without records left
    goes.  If the job is lost on the way, repairing again finds what is left to do.  The number of
    partitions that change comes to the driver, which lists the folders anyway.  Not for two repairs, or a repair
    and a reader, at one time.
    """
    spark, folder = catalog.sparkSession, _Folder(catalog.sparkSession, path)
    ledger = read_commits(spark, path)
    updates = fixed(checksum_updates(catalog, ledger))
    report = fixed(repair_report(ledger, updates))
    changes = updates.select("target", "script").distinct()
    aligned = ledger.filter("success").join(changes, ["target", "script"], "left_semi")
    failed = ledger.filter(F.col("target").isNotNull() & ~F.col("success"))
    touched = failed.select(*PARTITIONS).union(aligned.select(*PARTITIONS)).distinct().collect()
    if not touched:
        return report
    names = {tuple(t): f"commit={t['commit']}/run={t['run']}/part={t['part']}" for t in touched}
    rows = spark.read.schema(STORED_SCHEMA).option("basePath", folder.path).parquet(
        *[f"{folder.path}/{name}" for name in names.values()])
    new = fixed(repaired(rows, updates))
    folder.touch(f"_repairs/{uuid.uuid4().hex}")
    (new.repartition(*PARTITIONS, F.pmod(F.xxhash64("target", "installed_rank"), F.lit(8))).sortWithinPartitions("target", "installed_rank")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(folder.path))
    left = {tuple(t) for t in new.select(*PARTITIONS).distinct().collect()}
    for partition, name in names.items():
        if partition not in left:
            folder.delete(name)
    return report


def advance_snapshot(spark: SparkSession, path: str, state_path: str) -> DataFrame:
    """The snapshot of a ledger of commits, from the newest stored one and the commits after it; it is stored too.

    Only the files of newer commits are read.  A repair changes old commits, so the first snapshot after one is
    built from the whole ledger.  Snapshots lie below ``state_path`` as ``repairs=<count>/upto=<commit>``.
    """
    store = _Folder(spark, state_path)
    repairs, last = len(_Folder(spark, path).names("_repairs/*")), last_commit(spark, path)
    below = f"repairs={repairs}"
    stored = [n for n in _numbers(store, f"{below}/upto=*") if store.names(f"{below}/upto={n}/_SUCCESS")]
    upto = max(stored, default=-1)
    if upto < last or not stored:
        snapshot = ledger_snapshot(read_commits(spark, path, upto, last))
        if stored:
            snapshot = merge_snapshots(spark.read.parquet(f"{store.path}/{below}/upto={upto}"), snapshot)
        snapshot.write.mode("overwrite").parquet(f"{store.path}/{below}/upto={last}")
    return spark.read.parquet(f"{store.path}/{below}/upto={last}")
