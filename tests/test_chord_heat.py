"""Chord heat sums without a shuffle of pairs equal the sums of the cells."""

from pyspark.sql import functions as F

from tracefold.operators import vectors


def test_sums_of_pairs_equal_those_of_cells_and_are_not_shuffled(spark):
    names = ["C", "Cm", "C7", "G#", "G", "Am", "x", None]
    rows = [(k % 7 if k % 41 else None, k, names[(k * k + k // 5) % 8]) for k in range(300)] + [(8, 1000, "D"), (9, 1001, "x")]
    t = spark.createDataFrame(rows, "track long, pos long, chord string")
    q = t.filter("track % 2 = 0")
    want = vectors.chord_heat(q, t, "track", "pos", "chord").filter("left <> right").groupBy("left", "right").agg(F.count("*").alias("cells"), F.sum("heat").alias("heat"))
    got = vectors.chord_heat_sums(q, t, "track", "chord")
    assert sorted(map(tuple, got.select("left", "right", "cells", "heat").collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join")]
    assert "Aggregate" not in above
