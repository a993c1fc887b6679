"""The registered queries of this package: operators over whole tables, and the columns that are compared."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeledger.llm import bpe, brown, byte_pairs, caps, contamination, conversation, line_runs, mixing, quality, resampling, shards, simhash, toxicity
from changeledger.llm.common import table
from changeledger.llm.oracles import SQL  # noqa: F401


def _remainder(modulus: int):
    """crc32 of doc_id as text, modulo."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination.contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shard_rows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                         F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_class_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return brown.class_scores(docs, _remainder(7) == 2)


def op4_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op5_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the deleted lines as text, and size and CRC-32 of what stays."""
    clean = line_runs.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return clean.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_deleted").cast("long").alias("n_deleted"),
                        F.col("n_deleted_words").cast("long").alias("n_deleted_words"),
                        F.array_join(F.transform("deleted", lambda x: x.cast("string")), ",").alias("deleted_lines"),
                        F.octet_length("text").cast("long").alias("kept_bytes"), F.md5("text").alias("kept_md5"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    counted = (table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
               .select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), bpe.count_tokens(F.col("text"), path).alias("n_tokens")))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"), _remainder(5) != 0)
    scored = docs.select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), model.score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), _remainder(3) != 1)
    scored = docs.select("doc_id", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"), model.score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    drawn = resampling.importance(docs, table(spark, sf_dir, "benchmark"), longest=1, buckets=10_000, seed=2024, percent=10, least_words=20, keep=["doc_id"])
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = conversation.Repair(conversation.damaged(turns)).report().withColumnRenamed("conv_id", "of_id")
    every, none = turns.select("conv_id").distinct(), hashlib.sha256().hexdigest()
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("of_id")), "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))


def op13_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    there_and_back = byte_pairs.round_trip(F.col("text"), path, public_tokenizers.PATTERN)
    coded = table(spark, sf_dir, "documents").select("doc_id", there_and_back.alias("coded")).select("doc_id", "coded.*")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_decontamination, op2_sharding, op3_class_model, op4_cap_filters, op5_line_runs, op6_mixing, op7_simhash, op8_token_counts, op9_quality, op10_toxicity,
    op11_resampling, op12_conversations, op13_byte_pairs)}
