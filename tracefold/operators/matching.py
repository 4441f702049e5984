"""Fingerprint matching: hash join, offset histogram, alignment, drift, transformation grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.music import landmark_hash
from ..storage import is_small
from .joins import dealt_join

#: The transformation grid: semitones and tempo ratios (fixed values).
SEMITONES = tuple(range(-6, 7))
TEMPOS = (0.80, 0.84, 0.88, 0.92, 0.96, 1.0, 1.04, 1.08, 1.12, 1.16, 1.20)


def hash_hits(query: DataFrame, candidates: DataFrame, q_key: str = "query", c_key: str = "candidate") -> DataFrame:
    """``query, candidate, i, qt, dt``: an equi-join on the hash, all occurrences with all.

    ``query`` has its key, ``i`` (number of the occurrence), ``h`` and ``t``; ``candidates`` a key, ``h``, ``t``. A
    query side of few rows is broadcast, so that candidates are matched where they are read and no common hash
    gathers them in one task. Of a large one, both sides are shuffled by hash and common hashes dealt out in blocks.
    """
    q = query.select(F.col(q_key).alias("query"), "i", "h", F.col("t").alias("qt"))
    c = candidates.select(F.col(c_key).alias("candidate"), "h", F.col("t").alias("ct"))
    both = c.join(F.broadcast(q), "h") if is_small(q) else dealt_join(c, q, "h", ["candidate", "ct"], ["query", "i"])
    return both.select("query", "candidate", "i", "qt", (F.col("ct") - F.col("qt")).alias("dt"))


def matched_hashes(hits: DataFrame, least: int) -> DataFrame:
    """Distinct matched occurrences a pair, pairs below ``least`` dropped."""
    return hits.groupBy("query", "candidate").agg(F.countDistinct("i").alias("matched")).filter(F.col("matched") >= least)


def offset_histogram(hits: DataFrame, width: float) -> DataFrame:
    """``query, candidate, shift, bin, votes`` over two grids half a bin apart; an occurrence votes once a bin."""
    grids = F.explode(F.array(F.lit(0), F.lit(1))).alias("shift")
    binned = hits.select("query", "candidate", "i", "dt", grids)
    bin_ = F.floor((F.col("dt") + F.col("shift") * (width / 2)) / width).alias("bin")
    return binned.select("query", "candidate", "i", "shift", bin_).distinct().groupBy("query", "candidate", "shift", "bin").agg(F.count("*").alias("votes"))


def best_bins(histogram: DataFrame) -> DataFrame:
    w = Window.partitionBy("query", "candidate").orderBy(F.desc("votes"), "shift", "bin")
    return histogram.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def alignments(hits: DataFrame, width: float, tolerance: float, least: int) -> DataFrame:
    """The best bin's alignment: centre (median), aligned occurrences, spans and ``peak_ratio``."""
    matched = matched_hashes(hits, least)
    top = best_bins(offset_histogram(hits, width)).select("query", "candidate", "shift", "bin")
    near = hits.join(top.join(matched, ["query", "candidate"]), ["query", "candidate"])
    inside = near.filter(F.floor((F.col("dt") + F.col("shift") * (width / 2)) / width) == F.col("bin"))
    centre = inside.groupBy("query", "candidate").agg(F.median("dt").alias("centre"))
    aligned = near.join(centre, ["query", "candidate"]).filter(F.abs(F.col("dt") - F.col("centre")) <= tolerance)
    return aligned.groupBy("query", "candidate").agg(
        F.first("matched").alias("matched"), F.first("centre").alias("centre"), F.countDistinct("i").alias("aligned"),
        F.min("qt").alias("q_start"), F.max("qt").alias("q_end"), F.greatest(F.lit(0.0), F.min(F.col("qt") + F.col("dt"))).alias("c_start"),
        F.greatest(F.lit(0.0), F.max(F.col("qt") + F.col("dt"))).alias("c_end"),
    ).withColumn("peak_ratio", F.col("aligned") / F.col("matched"))


def above_noise(results: DataFrame, floor: float) -> DataFrame:
    return results.filter(F.col("peak_ratio") >= floor)


def drift(hits: DataFrame, centres: DataFrame, reach: float = 1.5, least: int = 12) -> DataFrame:
    """Slope of the offset over query time around the centre, with its standard error."""
    near = hits.join(centres, ["query", "candidate"]).filter(F.abs(F.col("dt") - F.col("centre")) <= reach)
    fit = near.groupBy("query", "candidate").agg(
        F.count("*").alias("n"), F.regr_slope("dt", "qt").alias("slope"), F.regr_sxx("dt", "qt").alias("sxx"), F.regr_syy("dt", "qt").alias("syy"), F.regr_sxy("dt", "qt").alias("sxy"))
    rss = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    error = F.when(F.col("sxx") > 0, F.sqrt(rss / F.greatest(F.col("n") - 2, F.lit(1)) / F.col("sxx")))
    return fit.filter((F.col("n") >= least) & (F.col("sxx") > 0)).select("query", "candidate", "n", "slope", error.alias("slope_error"))


def anchor_pairs(peaks: DataFrame, key: str, time: str, frequency: str, amplitude: str, near: float, far: float, zones: int) -> DataFrame:
    """Each peak with the strongest later peak in each of the sub-zones of ``[near, far)``.

    A range self-join made an equi-join: targets stand under their own time bucket and the one before.
    """
    bucket = F.floor(F.col(time) / far)
    a = peaks.select(F.col(key), bucket.alias("_b"), F.col(time).alias("t1"), F.col(frequency).alias("f1"))
    b = peaks.select(F.col(key), F.explode(F.array(bucket, bucket - 1)).alias("_b"), F.col(time).alias("t2"), F.col(frequency).alias("f2"), F.col(amplitude).alias("a2"))
    pairs = a.join(b, [key, "_b"]).withColumn("gap", F.col("t2") - F.col("t1")).filter((F.col("gap") >= near) & (F.col("gap") < far))
    pairs = pairs.withColumn("zone", F.floor((F.col("gap") - near) * zones / (far - near)))
    w = Window.partitionBy(key, "t1", "f1", "zone").orderBy(F.desc("a2"), "t2", "f2")
    return pairs.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_b")


def pair_hashes(pairs: DataFrame, key: str, ticks: float, semitones=0, tempo=1.0) -> DataFrame:
    """``key, t, h``: pairs hashed, shifted by semitones (three units each) and stretched in time."""
    shift = (semitones if hasattr(semitones, "cast") else F.lit(semitones)) * 3
    pace = tempo if hasattr(tempo, "cast") else F.lit(tempo)
    h = landmark_hash(F.col("f1") + shift, F.col("f2") + shift, F.col("gap") / pace * ticks)
    return pairs.withColumn("h", h).withColumn("t", F.col("t1") / pace).filter("h is not null")


def variants(semitones=SEMITONES, tempos=TEMPOS) -> list[tuple[int, float, float]]:
    """Variant, semitones and tempo: 13 x 11 transformations at most, so a fixed size."""
    return [(k, float(s), float(t)) for k, (s, t) in enumerate((s, t) for s in semitones for t in tempos)]


def grid(spark, semitones=SEMITONES, tempos=TEMPOS) -> DataFrame:
    """``variants`` as a table ``variant, semitones, tempo``."""
    return spark.createDataFrame(variants(semitones, tempos), "variant int, semitones double, tempo double")


def best_variant(results: DataFrame, *keys: str) -> DataFrame:
    """Most aligned, then least stretched, then first."""
    w = Window.partitionBy(*keys).orderBy(F.desc("aligned"), F.abs(F.log2("tempo")), "variant")
    return results.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def transform_struct(semitones, tempo):
    """The transformation, NULL for identity."""
    identity = (semitones == 0) & (F.abs(tempo - 1) <= 0.0125)
    return F.when(~identity, F.struct(semitones.alias("semitones"), tempo.alias("tempo_ratio")))


def upsert(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the second pass replace those of the first; others of either stay."""
    names = [c for c in first.columns if c not in keys]
    a, b = first.withColumn("_a", F.lit(True)), second.withColumn("_b", F.lit(True))
    joined = a.alias("a").join(b.alias("b"), keys, "full")
    return joined.select(*keys, *(F.when(F.col("_b"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in names))
