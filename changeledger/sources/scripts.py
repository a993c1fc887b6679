"""Reading script files."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from changeledger.schema import BAD_SETTING, LOCATION_NOT_FOUND, LedgerError

FILESYSTEM_PREFIX = "filesystem:"


def qualified(spark: SparkSession, location: str) -> str:
    """A folder with scheme and without ``.``, ``..`` and a final slash, as scans name it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path)
    scheme, _, rest = full.toString().partition(":")
    host, slash, inside = rest.removeprefix("//").partition("/") if rest.startswith("//") else ("", "/", rest.lstrip("/"))
    parts: list[str] = []
    for part in inside.split("/"):
        if part == "..":
            if not parts:
                raise LedgerError(BAD_SETTING, f"location leads above the root: {location}")
            parts = parts[:-1]
        elif part not in ("", "."):
            parts.append(part)
    return f"{scheme}:{'//' + host if host else ''}/" + "/".join(parts)


def glob_escaped(path: str) -> str:
    """A path in which no character stands for others."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def _files(spark: SparkSession, root: str, name_glob: str) -> DataFrame:
    try:
        return (spark.read.format("binaryFile").option("recursiveFileLookup", True)
                .option("pathGlobFilter", name_glob).load(glob_escaped(root)))
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise LedgerError(LOCATION_NOT_FOUND, f"no such location: {root}") from error
        raise


def _below(root: str) -> Column:
    """The path of a file below its location."""
    # The scan gives qualified paths; the location is in front of the script.
    path = F.regexp_replace(F.col("path"), "^([a-z0-9]+):///", "$1:/")
    return F.when(path.startswith(f"{root}/"), F.substring(path, len(root) + 2, 2 ** 31 - 1)).otherwise(
        F.raise_error(F.concat(F.lit(f"{LOCATION_NOT_FOUND}: not below {root}: "), path)))


def _of_locations(spark: SparkSession, locations: Sequence[str], name_glob: str, *columns: str) -> DataFrame:
    frames = []
    for number, location in enumerate(locations):
        if not location.startswith(FILESYSTEM_PREFIX):
            raise LedgerError(BAD_SETTING, f"location must start with {FILESYSTEM_PREFIX}: {location}")
        root = qualified(spark, location.removeprefix(FILESYSTEM_PREFIX))
        frames.append(_files(spark, root, name_glob).filter(F.col("path").endswith(".sql")).select(
            F.lit(number).alias("location_no"), _below(root).alias("script"), *columns))
    if not frames:
        raise LedgerError(BAD_SETTING, "no location given")
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def read_scripts(spark: SparkSession, locations: Sequence[str], name_glob: str = "*.sql") -> DataFrame:
    """location_no, script, content of all files below the locations.

    ``script`` is the path below its location.  A location is ``filesystem:`` +
    any path Spark can read, relative and with ``..`` as well.  ``name_glob`` is applied before files are opened;
    ``content`` is only read when it is used.  ``list_scripts`` and ``read_contents`` open fewer files.
    """
    return _of_locations(spark, locations, name_glob, "content")


def list_scripts(spark: SparkSession, locations: Sequence[str], name_glob: str = "*.sql") -> DataFrame:
    """location_no, script, path, length, modificationTime of all files below the locations; none is opened.

    Choose on it, by ``PathFilter.matches``, by ``first_location`` or by time, then ``read_contents``.
    """
    return _of_locations(spark, locations, name_glob, "path", "length", "modificationTime")


def read_contents(listing: DataFrame) -> DataFrame:
    """The rows of a listing (its columns but path, length and time) with the ``content`` of their files.

    Only these files are opened.  Their paths come to the driver, which holds the paths of every scan it
    plans; a path that two rows name is read once.
    """
    spark = listing.sparkSession
    rows = listing.drop("length", "modificationTime")
    paths = [r["path"] for r in rows.select("path").distinct().collect()]
    if not paths:
        return rows.drop("path").withColumn("content", F.lit(None).cast("binary"))
    files = spark.read.format("binaryFile").load([glob_escaped(p) for p in paths])
    # equal expressions, not equal columns: a condition on the path of one location would else be tried on all files
    same = F.concat(F.lit("p"), F.col("path")) == F.concat(F.lit("p"), F.col("of_path"))
    return rows.join(files.select(F.col("path").alias("of_path"), "content"), same).drop("path", "of_path")


def first_location(scripts: DataFrame) -> DataFrame:
    """Each script once, from the first location that has it.

    The choice is made on paths alone; contents of the chosen files move once.
    """
    first = scripts.groupBy("script").agg(F.min("location_no").alias("location_no"))
    return scripts.join(first, ["script", "location_no"], "left_semi").drop("location_no")


def script_text(content: Column, charset: str = "UTF-8") -> Column:
    return F.decode(content, charset)
