"""Equi-joins of which one key may hold a large share of either side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import small_side

#: Rows of a key and side that one task joins.
BLOCK = 4096


def dealt_join(a: DataFrame, b: DataFrame, on: str, a_by: list[str], b_by: list[str], block: int = BLOCK) -> DataFrame:
    """The inner join of ``a`` and ``b`` on ``on``; keys with more than ``block`` rows are dealt out in blocks.

    A side's rows of such a key are dealt by a hash of ``a_by`` (``b_by``) into blocks, and each block of one side
    meets each of the other in a task of its own. Counts are aggregated where rows are read; rows of all other keys
    are joined once, as they are.
    """
    counts = a.groupBy(on).agg(F.count("*").alias("_na")).join(b.groupBy(on).agg(F.count("*").alias("_nb")), on)
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    crowded = counts.filter((F.col("_na") > block) | (F.col("_nb") > block)).select(on, blocks("_na").alias("_ka"), blocks("_nb").alias("_kb"))
    crowded = small_side(crowded)
    upto = lambda k: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(k), F.lit(1)) - 1))
    place = lambda by, k: F.pmod(F.xxhash64(*by), F.coalesce(F.col(k), F.lit(1))).cast("int")
    left = a.join(crowded, on, "left").withColumn("_i", place(a_by, "_ka")).withColumn("_j", upto("_kb")).drop("_ka", "_kb")
    right = b.join(crowded, on, "left").withColumn("_j", place(b_by, "_kb")).withColumn("_i", upto("_ka")).drop("_ka", "_kb")
    return left.join(right, [on, "_i", "_j"]).drop("_i", "_j")
