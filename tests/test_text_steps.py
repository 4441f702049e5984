"""Steps over many texts against plain versions: signatures, wanted runs of words, hits of a stored index."""

import random

from pyspark.sql import functions as F

from tracefold.functions import text as tx
from tracefold.operators import hash_index, pairs
from tracefold.storage import shared_folder


def test_signatures_are_those_of_the_expression(spark):
    r = random.Random(1)
    sets = [(k, ["".join(r.choice("ab é中") for _ in range(n)) for n in r.sample(range(90), k % 40)]) for k in range(150)]
    rows = spark.createDataFrame(sets, "k long, g array<string>").filter("size(g) > 0")
    want = {x["k"]: x["s"] for x in rows.select("k", tx.minhash(F.col("g"), 16).alias("s")).collect()}
    got = pairs.minhashes(rows, "k", "g", 16, "s")
    assert {x["k"]: x["s"] for x in got.collect()} == want


def test_wanted_runs_of_words(spark):
    r = random.Random(2)
    texts = [(k, [r.choice("abcd") for _ in range(r.randrange(0, 12))]) for k in range(1300)]
    wanted = {"a b c", "d d d", "b a b", "c c"}
    rows = spark.createDataFrame(texts, "k long, w array<string>").coalesce(1)
    got = pairs.wanted_runs(rows, "k", "w", 3, spark.createDataFrame([(g,) for g in wanted], "g string"), "g", " ").collect()
    want = sorted({(k, g) for k, w in texts for i in range(len(w) - 2) if (g := " ".join(w[i : i + 3])) in wanted})
    assert sorted((x["k"], x["g"]) for x in got) == want
    assert pairs.wanted_runs(rows, "k", "w", 3, spark.createDataFrame([], "g string"), "g", " ").count() == 0


def test_postings_meet_the_query_before_the_candidates_that_are_hidden(spark):
    index = hash_index.HashIndex(spark, shared_folder(spark, "index"), ("long", "long"), buckets=2, longest=5)
    index.add(spark.createDataFrame([(h, c, 0.0) for h in range(3) for c in range(12)], "h long, candidate long, t double"))
    index.remove(spark.createDataFrame([(3,)], "candidate long"))
    assert {x["h"]: x["parts"] for x in index.splits().collect()} == {0: 3, 1: 3, 2: 3}
    hits = index.hits(spark.createDataFrame([(7, 0, 1, 2.0)], "query long, i long, h long, t double"))
    assert sorted((x["candidate"], x["dt"]) for x in hits.collect()) == [(c, -2.0) for c in range(12) if c != 3]
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftOuter") < plan.index("Inner")
