"""For which pairs the near-copy stage moves texts: all that have the similarity, and few that have not."""

import random

from pyspark.sql import functions as F

from tracefold.llm import simhash


def family(r, n, edits, words=240):
    """Edits of one text, each with words of its own in other places."""
    base = [f"w{k}" for k in range(words)]
    out = []
    for k in range(n):
        own = list(base)
        for at in r.sample(range(words), edits):
            own[at] = f"e{k}x{at}"
        out.append(" ".join(own))
    return out


def similar(texts, similarity):
    sets = {i: set(simhash.shingle_hashes(simhash.words(t), 5).tolist()) for i, t in texts}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}


def test_prefixes_leave_all_pairs_of_the_similarity_and_few_others(spark):
    r = random.Random(1)
    texts = list(enumerate(family(r, 20, 2) + family(r, 20, 12) + family(r, 10, 1, 9) + [" ".join(r.choice("abc") for _ in range(n)) for n in (1, 2, 4, 5, 6, 300, 301, 3000)]))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for similarity in (0.8, 0.5):
        sets = simhash.signatures(docs, 5, similarity).withColumnRenamed("doc_id", "id")
        every = sets.select(F.col("id").alias("a")).join(sets.select(F.col("id").alias("b")), F.col("a") < F.col("b"))
        got = {tuple(x) for x in simhash.plausible(every, sets, similarity).collect()}
        want = similar(texts, similarity)
        assert want and want <= got, similarity
        assert len(got - want) < 0.1 * every.count(), (similarity, len(got), len(want), every.count())


def test_texts_are_not_moved_for_the_square_of_a_family(spark, monkeypatch):
    r = random.Random(2)
    texts = list(enumerate(family(r, 60, 2) + family(r, 60, 12)))
    moved, real = [], simhash.verified

    def counted(docs, near, *rest):
        moved.append(near.distinct().count())
        return real(docs, near, *rest)

    monkeypatch.setattr(simhash, "verified", counted)
    left = {x["doc_id"] for x in simhash.drop_near_copies(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    roots = {i: i for i, _ in texts}
    for a, b in sorted(similar(texts, 0.8)):
        a, b = sorted((roots[a], roots[b]))
        roots = {i: a if x == b else x for i, x in roots.items()}
    assert left == set(roots.values()) and 60 < len(left) < 120
    assert sum(moved) < 4 * len(texts), moved
