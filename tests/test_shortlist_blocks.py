"""Shortlists by matrices equal those row by row, hard vectors, ties and repeated ids included."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracefold.functions.music import cosine
from tracefold.operators import vectors


def hard(spark, n=400):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=5).round(1).tolist()) for k in range(n)]
    rows += [(n + k, rows[k][1]) for k in range(0, 60, 2)] + [(3, rows[9][1]), (1000, [0.0] * 5), (1001, [1e-9] * 5), (1050, [0.0] * 5)]
    rows += [(1100, None), (1101, [1.0, None, 2.0, 0.0, 1.0]), (1150, [1.0, 2.0]), (1102, [float("nan")] * 5), (1103, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (1200, [1e200] * 5), (None, [1.0] * 5)]
    return spark.createDataFrame(rows, "vec_id long, v array<double>")


def plain(q, c, k):
    pairs = c.select(F.col("vec_id").alias("candidate"), F.col("v").alias("_c")).join(q.select(F.col("vec_id").alias("query"), F.col("v").alias("_q")), F.col("query") != F.col("candidate"))
    pairs = pairs.select("query", "candidate", F.round(cosine(F.col("_q"), F.col("_c")), 9).alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "candidate")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query", "candidate", "rank", "score")


def bag(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_shortlist_by_matrices_equals_row_by_row(spark, monkeypatch):
    v = hard(spark)
    q = v.filter("vec_id % 50 = 0 or vec_id in (3, 1101)")
    want = bag(plain(q, v, 7))
    for cells, block in ((40, 10_000), (1 << 20, 10_000), (900, 4)):
        monkeypatch.setattr(vectors, "CELLS", cells)
        monkeypatch.setattr(vectors.in_blocks, "__defaults__", (block,))
        assert bag(vectors.shortlist(q, v, "vec_id", "vec_id", "v", 7)) == want
    assert vectors.shortlist(q.limit(0), v, "vec_id", "vec_id", "v", 7).count() == 0


def test_pairs_are_compared_in_tasks_and_never_made_into_rows(spark):
    v = spark.range(600).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(4)), lambda x: F.sin(x * (F.col("id") + 1)).cast("double")).alias("v"))
    plan = vectors.shortlist(v.filter("vec_id % 50 = 0"), v, "vec_id", "vec_id", "v", 3)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan
