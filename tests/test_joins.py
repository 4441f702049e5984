"""Joins of crowded keys equal plain ones and deal them out; artifacts of writers at once; prewarming."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tracefold import sources
from tracefold.operators import matching, sequences
from tracefold.operators.joins import dealt_join


@pytest.fixture(scope="module")
def rows(spark):
    """A key with two thirds of all rows, a null key, many small ones."""
    key = F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 9 > 0, F.concat(F.lit("k"), F.col("id") % 21))
    return spark.range(300).select(key.alias("key"), F.col("id").alias("x"))


def bag(df):
    return sorted(map(tuple, df.collect()))


def test_dealt_join_equals_a_plain_one(rows):
    a, b = rows, rows.select("key", F.col("x").alias("y")).filter("y % 2 = 0")
    for block in (7, 50, 10_000):
        got = dealt_join(a, b, "key", ["x"], ["y"], block)
        assert sorted(got.columns) == ["key", "x", "y"] and bag(got.select("key", "x", "y")) == bag(a.join(b, "key").select("key", "x", "y"))
    assert dealt_join(a.limit(0), b, "key", ["x"], ["y"]).count() == 0


def test_no_task_has_a_whole_crowded_key(spark, rows):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        b = rows.select("key", F.col("x").alias("y"))
        parts = [r["n"] for r in dealt_join(rows, b, "key", ["x"], ["y"], 40).withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count("*").alias("n")).collect()]
        assert max(parts) < 200 * 200 / 2 and sum(parts) == rows.join(b, "key").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_large_queries_of_hashes_are_dealt_out(spark, monkeypatch):
    from tracefold import storage

    q = spark.range(60).select(F.lit("q").alias("query"), F.col("id").alias("i"), (F.col("id") % 4).alias("h"), F.col("id").cast("double").alias("t"))
    c = spark.range(90).select((F.col("id") % 3).alias("candidate"), (F.col("id") % 5).alias("h"), F.col("id").cast("double").alias("t"))
    plain = bag(matching.hash_hits(q, c, "query", "candidate"))
    monkeypatch.setattr(storage.is_small, "__defaults__", (3,))
    monkeypatch.setattr(dealt_join, "__defaults__", (5,))
    assert bag(matching.hash_hits(q, c, "query", "candidate")) == plain and plain
    seq = spark.range(80).select((F.col("id") % 4).alias("track"), F.expr("id div 4").alias("pos"), (F.expr("id div 4") % 3).alias("s"))
    pairs = {tuple(r) for r in sequences.sharing(seq, "track", "pos", "s", 4).collect()}
    assert pairs == {(a, b) for a in range(4) for b in range(a + 1, 4)}


# ---- artifacts ---------------------------------------------------------------------------------------------------

SCHEMA = "artifact string, status string, reason string, value array<double>"


def computed(df):
    return df.select("artifact", "status", "reason", F.array(F.length("clip_id").cast("double"), F.rand()).alias("value"))


@pytest.fixture
def clips(spark):
    return spark.createDataFrame([("a", "ok", None), ("bb", "ok", None), ("ccc", "failed", "not a wav")], "clip_id string, status string, reason string")


def test_writers_at_once_leave_one_row_a_key(spark, clips, tmp_path):
    path = str(tmp_path / "fp")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda _: sources.artifacts(spark, path, clips, F.md5("clip_id"), computed, SCHEMA).count(), range(4)))
    assert len(list((tmp_path / "fp").glob("run=*"))) == 4
    rows = sources.artifacts(spark, path, clips, F.md5("clip_id"), computed, SCHEMA)
    first = sorted(map(tuple, rows.collect()), key=repr)
    assert len(first) == 3 and first == sorted(map(tuple, sources.artifacts(spark, path, clips, F.md5("clip_id"), computed, SCHEMA).collect()), key=repr)


def test_corrupt_rows_are_computed_again(spark, clips, tmp_path):
    path = str(tmp_path / "fp")
    sources.artifacts(spark, path, clips, F.md5("clip_id"), computed, SCHEMA).count()
    stored = spark.read.parquet(path).drop("run")
    damaged = stored.withColumn("value", F.when(F.col("artifact") == F.md5(F.lit("a")), F.array(F.lit(-1.0))).otherwise(F.col("value")))
    other = str(tmp_path / "damaged")
    damaged.write.parquet(f"{other}/run=0")
    (tmp_path / "damaged" / "run=00").mkdir()
    (tmp_path / "damaged" / "run=00" / "part-0.parquet").write_bytes(b"PAR1 no parquet at all")
    got = sources.artifacts(spark, other, clips, F.md5("clip_id"), computed, SCHEMA).collect()
    assert len(got) == 3 and all(r["value"][0] > 0 for r in got)
    assert spark.read.option("ignoreCorruptFiles", True).schema(f"{SCHEMA}, run string").parquet(other).filter("run not in ('0', '00')").count() == 1


def test_prewarming_says_what_could_not_be_computed(spark, clips, tmp_path):
    candidates = spark.createDataFrame([("a",), ("bb",), ("ccc",), ("gone",)], "candidate string")

    def sung(df):
        return computed(df).withColumn("status", F.when(F.col("value")[0] > 1, "failed").otherwise("ok")).withColumn("reason", F.when(F.col("status") == "failed", "too long"))

    kinds = {"fingerprint": (F.md5("clip_id"), computed, SCHEMA), "melody": (F.md5(F.concat("clip_id", F.lit("m"))), sung, SCHEMA)}
    for _ in range(2):
        got = {(r["candidate"], r["kind"]): r["reason"] for r in sources.prewarm(spark, str(tmp_path), candidates, clips, kinds).collect()}
        assert got == {("ccc", "fingerprint"): "not a wav", ("ccc", "melody"): "not a wav", ("gone", "fingerprint"): "audio_missing", ("gone", "melody"): "audio_missing", ("bb", "melody"): "too long"}
    assert sources.prewarm(spark, str(tmp_path), candidates.limit(0), clips, kinds).count() == 0
