"""Places of rows in an order over the whole table, without any task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import FEW_ROWS, Scratch

#: Bits of a row's number within its partition, as ``monotonically_increasing_id`` lays them out.
WITHIN = 33


def numbered(df: DataFrame, group: str, order: list[str], scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``gid`` and ``idx``, and the table of groups ``group, gid, rows``.

    ``gid`` numbers the groups from 0 (null first, strings bytewise), ``idx`` the rows of a group by ``order`` (nulls
    first); equal rows are numbered in any order. Rows are dealt out by ranges of (group, order), ties split too,
    and numbered where they are; what is summed afterwards has a row for each group and partition that holds some
    of it.
    """
    spark = df.sparkSession
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    dealt = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, F.col("_tie"))
    laid = scratch.store(dealt.sortWithinPartitions(*keys).drop("_tie").withColumn("_at", F.monotonically_increasing_id()), name)

    part = F.shiftright("_at", WITHIN).alias("_part")
    spans = laid.groupBy(group, part).agg(F.min("_at").alias("_low"), F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_on", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    groups = spans.groupBy(group).agg(F.min("_low").alias("_low"), F.sum("_n").alias("rows")).withColumn("_part", F.shiftright("_low", WITHIN))
    # groups that begin in a partition follow all that begin in those before it
    begun = groups.groupBy("_part").agg(F.count("*").alias("_k"))
    begun = begun.select("_part", F.coalesce(F.sum("_k").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy("_low"))
    groups = scratch.store(groups.join(begun, "_part").select(group, (F.col("_first") + within - 1).alias("gid"), "rows"), f"{name}-groups")

    spans, g = spans.alias("s"), groups.alias("g")
    spans = spans.join(g, F.col(f"s.{group}").eqNullSafe(F.col(f"g.{group}"))).select(F.col(f"s.{group}").alias("_group"), "_part", "_low", "_on", "gid")
    spans = scratch.store(spans, f"{name}-spans")
    spans = F.broadcast(spans) if spans.count() <= FEW_ROWS else spans
    rows = laid.withColumn("_part", part).join(spans.withColumnRenamed("_part", "_in"), F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_in")))
    return rows.withColumn("idx", F.col("_at") - F.col("_low") + F.col("_on")).drop("_at", "_part", "_in", "_low", "_on", "_group"), groups
