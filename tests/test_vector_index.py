"""The vector index against brute force: recall, exact scores, work, hard rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefold.operators import vector_index, vectors


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + k, [float(v) for v in row]) for k, row in enumerate(x)], "vec_id long, v array<double>").repartition(4)


@pytest.fixture(scope="module")
def structured(spark):
    """Six thousand descriptors of 64 numbers around 150 works, each a work's with noise."""
    rng = np.random.default_rng(0)
    works = rng.normal(size=(150, 64))
    x = works[rng.integers(0, 150, 6000)] + 0.35 * rng.normal(size=(6000, 64))
    return x, frame(spark, x).cache()


def test_recall_of_structured_descriptors(spark, structured):
    x, df = structured
    queries = df.filter("vec_id % 50 = 0")
    quantiser = vector_index.fit(df, "vec_id", "v")
    indexed = vector_index.index(df, "vec_id", "v", quantiser)
    assert indexed.count() == 6000 == indexed.select("id").distinct().count()
    got = vector_index.shortlist(queries, df, "vec_id", "vec_id", "v", probed=8, quantiser=quantiser, indexed=indexed).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 6000, 50):
        near = np.round(unit @ unit[q], 9)
        near[q] = -2
        truth = set(np.lexsort((np.arange(6000), -near))[:20].tolist())
        own = [r for r in got if r["query"] == q]
        assert [r["rank"] for r in sorted(own, key=lambda r: (-r["score"], r["candidate"]))] == list(range(1, 21))
        assert all(abs(r["score"] - near[r["candidate"]]) < 2e-9 for r in own)
        hit += len(truth & {r["candidate"] for r in own})
    assert hit / (120 * 20) >= 0.95
    seen = vector_index.estimates(indexed, queries, "vec_id", "v", quantiser, 8, 101).agg(F.sum("seen")).first()[0]
    assert seen < 0.1 * 120 * 6000  # a tenth of brute force


def test_all_lists_and_estimates_are_brute_force(spark, structured):
    x, _ = structured
    df = frame(spark, x[:400])
    queries = df.filter("vec_id % 50 = 0")
    got = vector_index.shortlist(queries, df, "vec_id", "vec_id", "v", k=5, probed=10_000, kept=400)
    want = vectors.shortlist(queries, df, "vec_id", "vec_id", "v", 5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_hard_vectors(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0]), (3, None), (50, [2.0, 0.0, 0.0]), (100, None), (150, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = vector_index.shortlist(df.filter("vec_id % 50 = 0"), df, "vec_id", "vec_id", "v", k=2)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 1, 1.0), (0, 50, 2, 1.0), (50, 0, 1, 1.0), (50, 1, 2, 1.0), (150, 0, 1, 0.0), (150, 1, 2, 0.0)]
    assert vector_index.shortlist(df, df.filter("vec_id = 3"), "vec_id", "vec_id", "v").count() == 0
    assert vector_index.shortlist(df.filter("vec_id = 3"), df, "vec_id", "vec_id", "v").count() == 0
