"""The stored index against a plain join of what was added and not removed."""

import pytest
from pyspark.sql import functions as F

from tracefold.operators import matching
from tracefold.operators.hash_index import HashIndex


def rows(spark, names, salt=0):
    """Fifty hashes a candidate, one of which everybody has five times."""
    own = spark.createDataFrame([(c,) for c in names], "candidate string").crossJoin(spark.range(50))
    h = F.when(F.col("id") % 10 == 0, F.lit(7)).otherwise(F.pmod(F.xxhash64("candidate", F.col("id") % 25, F.lit(salt)), F.lit(400)))
    return own.select("candidate", h.cast("long").alias("h"), (F.col("id") / 4).alias("t"))


@pytest.fixture
def query(spark):
    return spark.range(120).select(F.lit("q").alias("query"), F.col("id").alias("i"), F.pmod(F.col("id") * 13, F.lit(400)).alias("h"), F.col("id").cast("double").alias("t")).unionAll(
        spark.createDataFrame([("q", 999, 7, 1.0)], "query string, i long, h long, t double"))


def bag(df):
    return sorted(map(tuple, df.select("query", "candidate", "i", "qt", "dt").collect()))


def test_hits_follow_what_is_added_and_removed(spark, query, tmp_path):
    path = str(tmp_path / "index")
    index = HashIndex(spark, path, buckets=8, longest=20)
    assert index.hits(query).count() == 0
    first, more = rows(spark, ["a", "b", "c", "d", "e"]), rows(spark, ["f", "a"], salt=1)
    index.add(first)
    assert index.splits().count() >= 1  # the common hash is in parts
    assert bag(index.hits(query)) == bag(matching.hash_hits(query, first, "query", "candidate")) != []
    index.add(more)  # "a" is replaced
    live = first.filter("candidate <> 'a'").unionAll(more)
    assert bag(index.hits(query)) == bag(matching.hash_hits(query, live, "query", "candidate"))
    index.remove(spark.createDataFrame([("b",), ("nobody",)], "candidate string"))
    live = live.filter("candidate <> 'b'")
    want = bag(matching.hash_hits(query, live, "query", "candidate"))
    assert bag(index.hits(query)) == want == bag(index.hits(query, merge=True))
    again = HashIndex(spark, path, buckets=8, longest=20)  # as another session opens it
    again.compact()
    assert bag(again.hits(query)) == want and len(again.generations()) == 1 and again.splits().count() >= 1
    again.add(rows(spark, ["b"], salt=2))
    assert {r["candidate"] for r in again.postings().select("candidate").distinct().collect()} == set("abcdef")


def test_what_a_failed_append_left_is_not_read(spark, query, tmp_path):
    index = HashIndex(spark, str(tmp_path / "index"), buckets=4)
    index.add(rows(spark, ["a"]))
    before = bag(index.hits(query))
    index._write(rows(spark, ["z"]).withColumn("part", F.lit(0)).withColumn("gen", F.lit(index._first() + 1)), index._first())
    assert bag(index.hits(query)) == before


def test_no_exchange_stands_above_the_index(spark, query, tmp_path):
    index = HashIndex(spark, str(tmp_path / "index"), buckets=8)
    index.add(rows(spark, ["a", "b"]))
    index.remove(spark.createDataFrame([("b",)], "candidate string"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = index.hits(query, merge=True)._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")

    def walk(node, above):
        name = node.nodeName()
        if "Scan" in name and "postings" in node.toString().splitlines()[0]:
            found.append([x for x in above if x.startswith("Exchange")])
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k), [*above, name])

    found = []
    walk(plan, [])
    assert found == [[]] and "SortMergeJoin" in plan.toString() and "Bucketed: true" in plan.toString()
