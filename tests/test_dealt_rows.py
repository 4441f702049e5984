"""Rows of a query are brought together in as many tasks as their number asks for, before they are sorted or aggregated."""

from pyspark.sql import functions as F

from tracefold.plans import catalogue_fusion, catalogue_runs, engine


def largest(df, key):
    return df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.countDistinct(key).alias("k")).agg(F.max("n"), F.sum("k"), F.count("*")).first()


def test_tasks_follow_the_rows(spark):
    rows = spark.range(20_000).select((F.col("id") % 5000).alias("query"))
    most, queries, tasks = largest(engine.dealt(rows, "query", 500), "query")
    assert tasks == 40 and most <= 1000 and queries == 5000
    assert engine.dealt(rows, "query").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert engine.dealt(rows.limit(0), "query").count() == 0


def test_shortlists_and_rankings_deal_rows_out_first(spark, sf, monkeypatch):
    for q in (catalogue_runs.q84, catalogue_fusion.q37):
        want = sorted(map(tuple, q(spark, sf).collect()))
        monkeypatch.setattr(engine.dealt, "__defaults__", (100,))
        got = q(spark, sf)
        plan = got._jdf.queryExecution().executedPlan().toString()
        lines = [x for x in plan.splitlines() if "hashpartitioning(query" in x or "hashpartitioning(l_orderkey" in x]
        assert len(lines) == 1 and "REPARTITION_BY_NUM" in lines[0], plan
        assert sorted(map(tuple, got.collect())) == want
        monkeypatch.undo()
