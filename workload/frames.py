"""Catalogs, ledgers and script texts derived from the given tables.

Every document is a script of the target named by its ``source``; every event
is a run of one of them.  Documents labelled toxic were taken out of the
catalog after they had run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from changeledger.operators.distribute import use_checkpoint_dir
from changeledger.schema import BASELINE, REPEATABLE, SQL, UNDO_SQL
from changeledger.sources.commits import append_run


#: Schemas of the given tables: files are asked for them once.
_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _versions(block: Column, alternate: bool = False) -> Column:
    """Three spellings of version ``block / 10 . block % 10``; the third of them
    carries a word.  ``alternate`` spells the same versions another way."""
    major, minor = F.floor(block / 10).cast("string"), (block % 10).cast("string")
    if alternate:
        word = F.when(block % 3 == 1, ".rc01").otherwise("")
        return F.concat(major, F.lit(".0"), minor, word)
    return (F.when(block % 3 == 0, F.concat(F.lit("0"), major, F.lit("."), minor, F.lit(".0")))
            .when(block % 3 == 1, F.concat(major, F.lit("."), minor, F.lit("-RC1")))
            .otherwise(F.concat(major, F.lit("_"), minor)))


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """target, script, kind, version, dir_version, description, checksum, text, doc_id, block."""
    block = F.floor(F.col("doc_id") / 20)
    kind = F.when(block % 10 == 0, REPEATABLE).when(block % 10 == 9, UNDO_SQL).otherwise(SQL)
    df = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("target"), "lang", "text",
        F.col("n_chars").cast("int").alias("checksum"), kind.alias("kind"),
        F.when(block % 10 == 9, block - 1).when(block % 10 != 0, block).alias("block"))
    letter = F.when(F.col("kind") == REPEATABLE, "R").when(F.col("kind") == UNDO_SQL, "U").otherwise("V")
    number = F.col("doc_id").cast("string")
    df = df.withColumn("version", _versions(F.col("block")))
    return df.select(
        "target",
        F.concat("lang", F.lit("/"), letter, F.coalesce("version", F.lit("")), F.lit("__d"), number,
                 F.lit(".sql")).alias("script"),
        "kind", "version", F.floor(F.col("block") / 10).cast("string").alias("dir_version"),
        F.concat(F.lit("d"), number).alias("description"), "checksum", "text", "doc_id", "block")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
    return scripts(spark, sf_dir).drop("text").join(removed, "doc_id", "left_anti").drop("block")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = scripts(spark, sf_dir).drop("text")
    documents = table(spark, sf_dir, "documents").agg(F.count("*"))
    runs = table(spark, sf_dir, "events").withColumn(
        "doc_id", (F.col("user_id") * 7 + F.col("event_id") % 5) % documents.scalar())
    is_baseline = (F.col("event_type") == "signup") & (F.col("value") > 250) & (F.col("kind") == SQL)
    failed = (F.col("event_type") == "error") & F.col("target").isin("src1", "src2")
    return runs.join(known, "doc_id").select(
        "target", (F.col("event_id") + 1).cast("int").alias("installed_rank"),
        F.when(F.col("event_id") % 2 == 0, F.col("version"))
        .otherwise(_versions(F.col("block"), alternate=True)).alias("version"),
        "description",
        F.when(is_baseline, BASELINE).when(F.col("kind") == UNDO_SQL, UNDO_SQL).otherwise(SQL)
        .alias("type"),
        "script",
        F.when(F.col("value") < 10, F.col("checksum") + 1).otherwise(F.col("checksum")).alias("checksum"),
        F.lit("runner").alias("installed_by"), F.col("ts").alias("installed_on"),
        F.floor("value").cast("int").alias("execution_time"), (~failed).alias("success"))


def split_targets(frame: DataFrame) -> DataFrame:
    """Cut each target into targets of ten blocks of documents."""
    number = F.substring("description", 2, 20).cast("long")
    return frame.withColumn("target", F.concat(
        "target", F.lit("-"), F.floor(number / 200).cast("string")))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with their settings: whether DDL is transactional, placeholder values."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("target")).distinct().select(
        "target", (F.substring("target", 4, 9).cast("int") % 2 == 0).alias("transactional"),
        F.create_map(F.lit("word"), F.col("target")).alias("placeholders"),
        F.create_map(F.lit("schema"), F.concat(F.lit("s_"), F.col("target"))).alias("builtins"))


def fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources, which have records, and customers, which have none."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_name").alias("target"))
    return targets(spark, sf_dir).select("target").unionByName(customers)


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts(spark, sf_dir).select(
        "target", "script", (F.col("checksum") % 5 != 0).alias("success"),
        (F.col("checksum").cast("long") * 1000000).alias("elapsed_ms"),
        (F.col("doc_id") % 4).cast("int").alias("batch_no"),
        (F.col("checksum") % 3).alias("applied_in_batch"))


def repeated_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes, every sixth one twice; the second is later, and every other second one says that it failed."""
    number = F.regexp_extract("script", r"__d(\d+)\.sql", 1).cast("long")
    once = outcomes(spark, sf_dir)
    again = once.filter(number % 6 == 0).withColumn("success", F.col("success") & (number % 12 != 0)) \
        .withColumn("elapsed_ms", F.col("elapsed_ms") + 1000)
    return once.unionByName(again)


def odd_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with every fiftieth record without a target, and blank versions instead of none."""
    return ledger(spark, sf_dir).withColumn("version", F.coalesce("version", F.lit(""))).withColumn(
        "target", F.when(F.col("installed_rank") % 50 != 8, F.col("target")))


def ledger_folder(spark: SparkSession, sf_dir: str) -> str:
    """The ledger in a folder of three commits, the later ones much smaller."""
    use_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/ledger-{uuid.uuid4().hex}"
    records, rank = ledger(spark, sf_dir), F.col("installed_rank")
    share = F.when(rank % 10 < 8, 0).when(rank % 10 == 8, 1).otherwise(2)
    for commit in range(3):
        append_run(records.filter(share == commit), path, f"run{commit}", commit - 1, parts=16)
    return path


def with_placeholders(text: Column) -> Column:
    for word, use in [(" the ", " ${word} "), (" of ", " $${of} "), (" to ", " ${ledger:schema} "),
                      (" and ", " ${nope} ")]:
        text = F.replace(text, F.lit(word), F.lit(use))
    return text


def as_statements(text: Column) -> Column:
    """Sentences become statements, commas literals with a separator inside and
    dashes between words block comments with one."""
    for old, new in [('"', " "), ("$", " "), (".", ";"), (",", " ';' "), ("|", " /* ;\n */ ")]:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def statement_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scripts(spark, sf_dir).select("target", "script", as_statements(F.col("text")).alias("text"))


def _sentences(text: Column) -> Column:
    """Parts of a text between full stops, with ASCII signs and control characters as spaces; blank ones left out."""
    plain = F.regexp_replace(text, r"[\x00-\x1F!-\-/:-@\[-`{-~\x7F]", " ")
    return F.filter(F.transform(F.split(plain, "[.]"), lambda s: F.btrim(s)), lambda s: s != "")


def dialect_scripts(spark: SparkSession, sf_dir: str, forms: list[str]) -> DataFrame:
    """Scripts of one statement per sentence, in the given forms by turns; ``{s}`` stands for the sentence."""
    def written(sentence: Column, place: Column) -> Column:
        found = F.lit(None).cast("string")
        for number, form in enumerate(forms):
            found = F.when(place % len(forms) == number, F.replace(F.lit(form), F.lit("{s}"), sentence)).otherwise(found)
        return found

    return scripts(spark, sf_dir).select("target", "script", F.array_join(
        F.transform(_sentences(F.col("text")), written), "").alias("text"))


def shared_names(frame: DataFrame) -> DataFrame:
    """Scripts under names that other targets use for other texts; needs doc_id."""
    return frame.withColumn("script", F.concat(F.lit("s"), F.floor(F.col("doc_id") / 20).cast("string")))


def _page_of(script: Column) -> Column:
    return F.regexp_extract(script, r"(\d+)\.sql$", 1).cast("long")


def page_fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_scripts with the pages of a language dealt to fifty targets."""
    return page_scripts(spark, sf_dir).withColumn(
        "target", F.concat("target", F.lit("-"), (_page_of(F.col("script")) % 50).cast("string")))


def page_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages in location 0, and those of two languages in location 1 as well."""
    pages = page_scripts(spark, sf_dir)
    return pages.withColumn("location_no", F.lit(0)).unionByName(
        pages.filter(F.col("target").isin("en", "fr")).withColumn("location_no", F.lit(1)))


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, path (host and path of the URL), html."""
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", r"^https?://([^?#]*)", 1).alias("path"), "html")


def page_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as script files below a numbered folder, some of them in the wrong one."""
    df = page_paths(spark, sf_dir).select(
        "page_id", "html", F.regexp_extract("path", r"/([a-z]+)/", 1).alias("target"),
        F.regexp_extract("path", r"(\d+)[^/]*/?$", 1).cast("int").alias("number"))
    page = F.col("page_id").cast("string")
    version = F.col("number") + F.when(F.col("page_id") % 7 == 0, 1).otherwise(0)
    name = (F.when(F.col("page_id") % 11 == 0, F.concat(F.lit("R1__p"), page))
            .when(F.col("page_id") % 11 == 1, F.concat(F.lit("Vx__p"), page))
            .when(F.col("page_id") % 11 == 2, F.concat(F.lit("R__p"), page))
            .when(F.col("page_id") % 11 == 3, F.concat(F.lit("note"), page))
            .otherwise(F.concat(F.lit("V"), version.cast("string"), F.lit("."),
                                (F.col("page_id") % 2).cast("string"), F.lit("__p"), page)))
    folder = F.when(F.col("page_id") % 13 == 0, "misc").otherwise(F.col("number").cast("string"))
    return df.select("target", F.concat(folder, F.lit("/"), name, F.lit(".sql")).alias("script"),
                     F.encode("html", "UTF-8").alias("content"))
