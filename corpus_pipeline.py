"""A corpus pipeline of operators of changeledger.llm: each stage works on what its predecessor kept.

For every stage: NULL and empty texts are texts without words, which no stage but the mix takes out (a source
without words has no target); texts are whole, whatever their length; of ties and repeated rows each stage says below what
it does; an empty table gives an empty result; further columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeledger.llm import contamination, mixing, shards, simhash, toxicity
from changeledger.llm.common import settle, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go: score 0.7 or more. Equal texts share their fate. The model learns from the labels of the
    given tables, except those held out; without labels every document stays."""
    learn = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    model = toxicity.fit_toxicity(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), learn)
    return toxicity.without_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays; of several rows with that id the
    first as written. Texts without words are one group."""
    return simhash.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go; equal texts share their fate. Without items all stay."""
    return contamination.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; equal rows equally often. NULL is a source, the last."""
    return mixing.repeated(docs)


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of each row; equal texts share a shard, equal rows have slots of their own."""
    return shards.shard_rows(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", place_in_shards),
]

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again before the next stage."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
