"""Training pairs from a catalogue: groups, positives, hard negatives. Draws are ordered by a seeded hash."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import distinguishable_title
from ..storage import materialised, small_side


def draw_order(seed: int, *columns: str) -> Column:
    """A reproducible shuffle: rows in the order of a hash of the seed and their key."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)), 256)


def groups(catalogue: DataFrame) -> DataFrame:
    """Exact counts of each title, whatever its size; members are not gathered."""
    by = catalogue.filter(F.trim("work_title") != "").groupBy("work_title", "language").agg(F.count("*").alias("n"), F.count_if(~F.col("instrumental")).alias("vocal"))
    most = F.max(F.when(F.col("language").isNotNull(), F.col("vocal")))
    return by.groupBy("work_title").agg(F.sum("n").alias("n_total"), F.sum("vocal").alias("n_vocal"), F.count_if(F.col("language").isNotNull() & (F.col("vocal") > 0)).alias("n_languages"), F.coalesce(most, F.lit(0)).alias("most_vocal"))


def qualifying(grouped: DataFrame, least: int = 2, most: int = 10, min_words: int = 3) -> DataFrame:
    return grouped.filter(F.col("n_vocal").between(least, most) & distinguishable_title(F.col("work_title"), min_words) & (F.col("most_vocal") >= 2))


def singletons(grouped: DataFrame) -> DataFrame:
    return grouped.filter("n_total = 1")


def positive_pairs(catalogue: DataFrame, pool: DataFrame, seed: int, most: int) -> DataFrame:
    """One pair of vocal performances in one language a title; ``most`` titles, all by hash order."""
    titles = pool.select("work_title").withColumn("_o", draw_order(seed, "work_title")).orderBy("_o", "work_title").limit(most)
    vocal = catalogue.filter(~F.col("instrumental") & F.col("language").isNotNull()).join(titles, "work_title")
    count = F.count("*").over(Window.partitionBy("work_title", "language"))
    vocal = vocal.withColumn("_n", count).filter("_n >= 2").withColumn("_l", draw_order(seed, "work_title", "language")).withColumn("_p", draw_order(seed, "performance_id"))
    first = F.min("_l").over(Window.partitionBy("work_title"))
    vocal = vocal.withColumn("_first", first).filter("_l = _first")
    w = Window.partitionBy("work_title").orderBy("_p", "performance_id")
    two = vocal.withColumn("_r", F.row_number().over(w)).filter("_r <= 2")
    return two.groupBy("work_title", "language").agg(F.max(F.when(F.col("_r") == 1, F.col("performance_id"))).alias("a"), F.max(F.when(F.col("_r") == 2, F.col("performance_id"))).alias("b"))


def hard_negatives(catalogue: DataFrame, exclude: DataFrame, key: str, seed: int) -> DataFrame:
    """Pairs of two works that share ``key`` (performer, or language), each work used once.

    Works of one key are dealt out in hash order and paired with their neighbour, which needs no used-set: an
    entry, one performance a work, falls into one pair at most.
    """
    entries = catalogue.filter(~F.col("instrumental") & F.col(key).isNotNull()).join(exclude.select("work_title").distinct(), "work_title", "left_anti")
    one = Window.partitionBy("work_title").orderBy(draw_order(seed, "performance_id"), "performance_id")
    entries = entries.withColumn("_r", F.row_number().over(one)).filter("_r = 1").drop("_r")
    w = Window.partitionBy(key).orderBy(draw_order(seed, "work_title"), "work_title")
    dealt = entries.withColumn("_k", F.row_number().over(w)).withColumn("_pair", F.floor((F.col("_k") - 1) / 2))
    return dealt.groupBy(key, "_pair").agg(F.count("*").alias("_n"), F.min(F.struct("_k", "performance_id")).alias("x"), F.max(F.struct("_k", "performance_id")).alias("y")).filter("_n = 2").select(
        key, F.col("x.performance_id").alias("a"), F.col("y.performance_id").alias("b"))


def one_pair_a_key(entries: DataFrame, key: str, seed: int, used: DataFrame | None = None) -> DataFrame:
    """``key, title_a, a, title_b, b``: for each key two works that no other key has, by rounds of mutual choice.

    ``entries`` has ``key, work_title, performance_id``; ``used`` titles are taken. Keys have an order of precedence
    and a work's standing within a key its own, both hashes of the seed. The result is that of going through the keys
    by precedence, each taking its two best works that are left. Keys do not wait for that: in a round a key settles
    when its two best works have no unsettled key of higher precedence, so the first one always does, and a chain of
    keys that wait for each other is short at random precedence. A key with fewer than two works left has no pair,
    which makes the result maximal.

    What is gathered at a key is two rows, chosen before rows move; what is gathered at a work is the least
    precedence of its keys.
    """
    rank = draw_order(seed, "_key")
    rows = entries.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"), "work_title", "performance_id")
    rows = rows.groupBy("_key", "work_title").agg(F.min_by("performance_id", F.struct(draw_order(seed, "performance_id"), F.col("performance_id"))).alias("performance_id"))
    if used is not None:
        rows = rows.join(used.select("work_title").distinct(), "work_title", "left_anti")
    rows = rows.withColumn("_rank", F.struct(rank.alias("h"), F.col("_key").cast("string").alias("k"))).withColumn("_o", draw_order(seed, "_key", "work_title"))
    left, found = materialised(rows, "free-works"), []
    while True:
        two = Window.partitionBy("_key").orderBy("_o", "work_title")
        best = left.withColumn("_r", F.row_number().over(two)).filter("_r <= 2")
        able = best.groupBy("_key").agg(F.count("*").alias("_n")).filter("_n = 2").select("_key")
        # works of keys that can no longer have a pair wait for nobody
        live = left.join(small_side(able), "_key", "left_semi")
        first = live.groupBy("work_title").agg(F.min("_rank").alias("_first"))
        own = best.join(able, "_key", "left_semi").join(first, "work_title").groupBy("_key").agg(
            F.every(F.col("_rank") == F.col("_first")).alias("_all"), F.min(F.struct("_o", "work_title", "performance_id")).alias("x"), F.max(F.struct("_o", "work_title", "performance_id")).alias("y"))
        settled = materialised(own.filter("_all").select("_key", F.col("x.work_title").alias("title_a"), F.col("x.performance_id").alias("a"), F.col("y.work_title").alias("title_b"), F.col("y.performance_id").alias("b")), "settled")
        if settled.isEmpty():
            break
        found.append(settled)
        gone = settled.select(F.explode(F.array("title_a", "title_b")).alias("work_title"))
        left = materialised(live.join(small_side(settled.select("_key")), "_key", "left_anti").join(small_side(gone), "work_title", "left_anti"), "free-works")
    none = settled if not found else found[0]
    for more in found[1:]:
        none = none.unionByName(more)
    return none.withColumnRenamed("_key", key)


def matched_negatives(catalogue: DataFrame, exclude: DataFrame, seed: int, most: int | None = None) -> DataFrame:
    """``kind, key, title_a, a, title_b, b``: works of one performer, then works of one language, each work used once.

    Vocal performances only; works of ``exclude`` (``work_title``) are taken. All pairs, or ``most`` of them, those of
    performers first; languages are only tried for what is missing.
    """
    vocal = catalogue.filter(~F.col("instrumental") & (F.trim("work_title") != ""))
    out, used, missing = [], exclude.select("work_title"), most
    for key, kind in (("performer", "negative_same_performer"), ("language", "negative_same_language")):
        pairs = one_pair_a_key(vocal.filter(F.trim(key) != ""), key, seed, used).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), "title_a", "a", "title_b", "b")
        chosen = materialised(pairs if missing is None else pairs.orderBy(draw_order(seed, "key"), "key").limit(missing), "negatives")
        out.append(chosen)
        if missing is not None:
            missing -= chosen.count()
            if missing <= 0:
                break
        used = used.unionAll(chosen.select(F.explode(F.array("title_a", "title_b"))))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def sample_pairs(catalogue: DataFrame, positives: int, negatives: int, seed: int, from_singles: bool = True) -> DataFrame:
    """``label, kind, work_title, other_work_title, language, left_id, right_id``: a whole calibration sample.

    Positives are two performances of one work, at most one pair a work. Negatives are of two works, none of which
    the positives or another negative use, drawn from works with a single performance (nobody can have covered
    them), or from the pool of the positives.
    """
    grouped = groups(catalogue)
    pool = qualifying(grouped)
    pos = materialised(positive_pairs(catalogue, pool, seed, positives), "positives")
    source = catalogue.join((singletons(grouped) if from_singles else pool).select("work_title"), "work_title", "left_semi")
    neg = matched_negatives(source, pos, seed, negatives)
    language = catalogue.select("performance_id", F.col("language").alias("_language"))
    neg = neg.join(language.toDF("a", "la"), "a").join(language.toDF("b", "lb"), "b").withColumn("language", F.when(F.col("la") == F.col("lb"), F.col("la")))
    one = pos.select(F.lit(1).alias("label"), F.lit("positive").alias("kind"), "work_title", F.lit(None).cast("string").alias("other_work_title"), "language", F.col("a").alias("left_id"), F.col("b").alias("right_id"))
    none = neg.select(F.lit(0).alias("label"), "kind", F.col("title_a").alias("work_title"), F.col("title_b").alias("other_work_title"), "language", F.col("a").alias("left_id"), F.col("b").alias("right_id"))
    return one.unionByName(none)


def first_by_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def with_overshoot(n: int, factor: float = 1.25) -> int:
    return math.ceil(n * factor)
