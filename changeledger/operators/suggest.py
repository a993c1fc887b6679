"""Nearest known key for keys that are not known."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

MAX_DISTANCE = 4


def nearest_key(keys: DataFrame, known: Sequence[str], key: str = "key",
                max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Distinct unknown keys with the known key closest by edit distance (the first
    of equally close ones), or NULL when all are farther than ``max_distance``.

    ``known`` is the caller's own list of names; it becomes part of the
    expression, so nothing is joined.
    """
    names = F.array(*map(F.lit, known))
    ranked = F.transform(names, lambda k, i: F.struct(
        F.levenshtein(F.col(key), k).alias("distance"), i.alias("place"), k.alias("name")))
    unknown = keys.select(key).distinct().filter(~F.col(key).isin(list(known)))
    best = unknown.withColumn("best", F.array_min(ranked))
    return best.select(key, F.when(
        F.col("best.distance") <= max_distance, F.col("best.name")).alias("suggestion"))
