"""Mutual neighbours in passes equal those of stored cells."""

import numpy as np
import pytest

from tracefold.operators import vectors


@pytest.mark.parametrize(("extra", "bins"), [([], 256), ([], 3), ([(5, [1.0, 2.0, 3.0])], 256), ([(950, [0.0, 0.0, 0.0])], 16)])
def test_passes_equal_stored_cells(spark, monkeypatch, extra, bins):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(vectors, "CELLS", 300)
    df = spark.createDataFrame([(k, rng.normal(size=3).round(1).tolist()) for k in range(300)] + extra, "vec_id long, v array<double>")
    q = df.filter("vec_id % 50 = 0 or vec_id = 5")
    want = vectors.mutual_neighbours(vectors.distance_cells(q, df, "vec_id", "vec_id", "v"), "i", "j", "distance", 0.3)
    got = vectors.mutual_cells(q, df, "vec_id", "vec_id", "v", 0.3, bins=bins)
    rows = sorted(map(tuple, got.select("i", "j", "distance").collect()))
    assert rows == sorted(map(tuple, want.select("i", "j", "distance").collect())) and rows
    if not any(k == 5 for k, _ in extra):
        assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
