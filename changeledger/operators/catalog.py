"""From script rows to a checked catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from changeledger.functions.arrays import add_once
from changeledger.functions.checksum import script_checksum
from changeledger.functions.paths import (
    DIRECTORY_VERSION_PATTERN, Naming, PathFilter, directory_version)
from changeledger.functions.versions import in_family, version_key
from changeledger.operators.distribute import lookup
from changeledger.operators.frames import item_key, prepare_catalog
from changeledger.schema import (
    DUPLICATE_VERSION, INVALID_VERSION, LEGACY_REPEATABLE, PROBLEM_COLUMNS, REPEATABLE, SQL,
    UNDO_SQL)

# location_no is there where the scripts have it: the place of their location.
CATALOG_COLUMNS = ["target", "script", "kind", "version", "vsort", "dir_version", "dir_vsort",
                   "description", "checksum", "item_key"]


def classify(scripts: DataFrame, naming: Naming = Naming()) -> DataFrame:
    """Add kind, version, vsort and description, read from the file name."""
    script = F.col("script")
    named = add_once(scripts, {"kind": naming.kind(script), "version": naming.version(script),
                               "description": naming.description(script)})
    return add_once(named, {"vsort": version_key(F.col("version"))})


def build_catalog(scripts: DataFrame, path_filter: PathFilter = PathFilter(),
                  naming: Naming = Naming(), directory_versions: bool = False,
                  directory_regex: str = DIRECTORY_VERSION_PATTERN
                  ) -> tuple[DataFrame, DataFrame]:
    """(catalog, problems) from rows of target, script, content.

    ``directory_versions`` reads a version from the folder as well and asks each
    versioned file to belong to its family.  ``content`` is reduced to its
    checksum here, is not read for the problems, and does not reach a shuffle.
    """
    df = classify(scripts.filter(path_filter.matches(F.col("script"))), naming)
    versioned = F.col("kind").isin(SQL, UNDO_SQL)
    folder = directory_version(F.col("script"), directory_regex) if directory_versions else None
    df = add_once(df, {"dir_version": F.when(versioned, folder).cast("string")})
    df = add_once(df, {"dir_vsort": version_key(F.col("dir_version"))})

    no_directory = F.lit(directory_versions) & versioned & F.col("dir_vsort").isNull()
    foreign = F.lit(directory_versions) & versioned & ~in_family(F.col("vsort"), F.col("dir_vsort"))
    code = (F.when(F.col("kind").isin(INVALID_VERSION, LEGACY_REPEATABLE), F.col("kind"))
            .when(no_directory | foreign, INVALID_VERSION))
    detail = (F.when(F.col("kind") == LEGACY_REPEATABLE, "numbered repeatable")
              .when(F.col("kind") == INVALID_VERSION, "file name cannot be read")
              .when(no_directory, "no version in the directory")
              .otherwise(F.concat(F.col("version"), F.lit(" is not in directory version "),
                                  F.col("dir_version"))))
    df = add_once(df, {"code": code, "detail": detail})
    usable = df.filter(F.col("code").isNull() & F.col("kind").isin(SQL, UNDO_SQL, REPEATABLE))
    catalog = usable.withColumn("checksum", script_checksum(F.col("content"))) \
        .withColumn("item_key", item_key()).select(
        *CATALOG_COLUMNS, *[c for c in ("location_no",) if c in scripts.columns])
    bad = df.filter(F.col("code").isNotNull())
    return catalog, bad.select(*PROBLEM_COLUMNS).unionByName(duplicate_versions(catalog))


def duplicate_versions(catalog: DataFrame) -> DataFrame:
    """A 2002 row for every script whose version an earlier script has, by location
    and path; the detail names that script.  Undo scripts are compared among
    themselves.  One path in two locations is such a case, also for repeatables
    (their version is none, so they are compared by path)."""
    items = prepare_catalog(catalog)
    place = F.col("location_no").cast("long") if "location_no" in items.columns else F.lit(0).cast("long")
    items = items.select("target", "kind", F.coalesce(F.concat(F.lit("v"), F.col("vsort")), F.concat(F.lit("s"), F.col("script"))).alias("name"),
                         "script", place.alias("place"))
    keys = ["target", "kind", "name"]
    first = F.struct("place", "script")
    doubled = (items.groupBy(*keys).agg(F.min(first).alias("first"), F.count("*").alias("n"))
               .filter("n > 1"))
    # Equal rows of one place and path (a folder given twice) are counted, and all but one reported.
    counted = items.groupBy(*keys, "place", "script").agg(F.count("*").alias("times"))
    later = (lookup(counted, doubled, keys, ["script"], "inner", weight="n")
             .withColumn("times", F.col("times") - (F.col("first") == first).cast("long")).filter("times > 0"))
    return (later.withColumn("detail", F.concat(F.col("first.script"), F.when(
                F.col("first.script") == F.col("script"), F.concat(F.lit(" in location "), F.col("first.place").cast("string"))).otherwise("")))
            .withColumn("code", F.lit(DUPLICATE_VERSION))
            .withColumn("times", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))))
            .select(*PROBLEM_COLUMNS))
