"""How common a pattern is: document frequencies, idf, degradation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.music import idf

WORK_CLASSES = ("VERSION", "LYRICS", "EXCERPT_WORK")


def common_threshold(share: float = 0.01) -> float:
    return math.log(1 / share)


def with_idf(patterns: DataFrame, frequencies: DataFrame, size: DataFrame, on: list[str], share: float = 0.01) -> DataFrame:
    """Patterns with ``df`` (0 for unseen ones), ``idf`` and ``is_common``; ``size`` is one row with ``n``."""
    one = size.select(F.col(size.columns[0]).alias("_size")).limit(1)
    out = patterns.join(frequencies, on, "left").crossJoin(F.broadcast(one))
    out = out.withColumn("df", F.coalesce("df", F.lit(0))).withColumn("idf", idf(F.col("_size"), F.col("df")))
    return out.withColumn("is_common", (F.col("_size") > 0) & (F.col("idf") < common_threshold(share))).drop("_size")


def commonality(patterns: DataFrame, key: str) -> DataFrame:
    """Mean idf (repeats count) and largest document frequency of each key's patterns."""
    return patterns.groupBy(key).agg(F.count("*").alias("n_patterns"), F.avg("idf").alias("mean_idf"), F.max("df").alias("corpus_frequency"))


def should_degrade(cls, mean_idf, size, threshold: float):
    known = cls.isin(*WORK_CLASSES) & (size > 0) & (mean_idf < threshold)
    return F.coalesce(known, F.lit(False))
