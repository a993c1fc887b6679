"""A bounded training sample of labelled texts, trained on in one task; the rest of a classifier is spread out."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def training_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int) -> DataFrame:
    """text, target (0 or 1) of at most ``rows`` labelled documents for which ``learn`` holds.

    Chosen by the hash of doc_id among the narrow labels, before any text is read: at most ``rows`` ids are
    broadcast. Several labels of an id count as the largest, several texts as the first in order; NULL ids
    and NULL labels are not used.
    """
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learn)
             .groupBy("doc_id").agg(F.max(label).cast("int").alias("target"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
             .select(F.col("doc_id").alias("of_id"), "target"))
    return (docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("of_id"))
            .groupBy("of_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("target").alias("target")))


def fit(sample: DataFrame, train: Callable[[Iterator[pa.RecordBatch]], object]) -> object:
    """Run ``train`` over the bounded sample in one task, in the order of a hash, and fetch the model."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(batches))], pa.binary())], ["model"])

    ordered = sample.repartition(1).sortWithinPartitions(F.xxhash64("of_id"), "of_id")
    row = ordered.mapInArrow(task, "model binary").first()
    # a plan that is known to be empty runs no task
    return pickle.loads(row["model"]) if row is not None else train(iter(()))
