"""Ordered sequences: folding, n-grams, intervals, windows, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import small_side
from .cells import common_runs
from .joins import dealt_join


def fold_repeats(df: DataFrame, key: str, order: list[str], symbol: str) -> DataFrame:
    """Rows whose symbol differs from the one before, numbered anew as ``pos`` from 1."""
    w = Window.partitionBy(key).orderBy(*order)
    kept = df.withColumn("_before", F.lag(symbol).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    kept = kept.filter(F.col("_first") | ~F.col(symbol).eqNullSafe(F.col("_before"))).drop("_before", "_first")
    return kept.withColumn("pos", F.row_number().over(w).cast("long"))


def islands(df: DataFrame, key: str, order: list[str], symbol: str, start: str, end: str) -> DataFrame:
    """Adjacent repeats merged into one row with the first start and the last end."""
    w = Window.partitionBy(key).orderBy(*order)
    change = F.when(F.col(symbol).eqNullSafe(F.lag(symbol).over(w)), 0).otherwise(1)
    group = F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (df.withColumn("_change", change).withColumn("island", group).groupBy(key, "island")
            .agg(F.first(symbol).alias(symbol), F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")))


def ngrams(df: DataFrame, key: str, order: str, symbol: str, sizes: range, separator: str = " ") -> DataFrame:
    """``key, pos, n, gram``: runs of n successive symbols, joined."""
    w = Window.partitionBy(key).orderBy(order)
    longest = max(sizes)
    ahead = [F.col(symbol).cast("string")] + [F.lead(F.col(symbol).cast("string"), k).over(w) for k in range(1, longest)]
    df = df.select(key, F.col(order).alias("pos"), *(a.alias(f"_{k}") for k, a in enumerate(ahead)))
    grams = F.array(*(F.struct(F.lit(n).alias("n"), F.when(F.col(f"_{n - 1}").isNotNull(), F.concat_ws(separator, *(F.col(f"_{k}") for k in range(n)))).alias("gram")) for n in sizes))
    return df.select(key, "pos", F.inline(grams)).filter("gram is not null")


def intervals(df: DataFrame, key: str, order: str, pitch: str) -> DataFrame:
    """``key, pos, step``: the next pitch less this one."""
    w = Window.partitionBy(key).orderBy(order)
    return df.select(key, F.col(order).alias("pos"), (F.lead(pitch).over(w) - F.col(pitch)).alias("step")).filter("step is not null")


def document_frequency(df: DataFrame, document: str, pattern: str, *by: str) -> DataFrame:
    """Documents that have each pattern, a document counting once."""
    return df.select(document, pattern, *by).distinct().groupBy(pattern, *by).agg(F.count("*").alias("df"))


def longest_common_runs(df: DataFrame, key: str, order: str, symbol: str, least: int) -> DataFrame:
    """``left, right, run``: the longest run of equal successive symbols of two sequences, from ``least`` symbols on."""
    return common_runs(df, key, order, symbol, least, each=False)


def longest_common_per_start(df: DataFrame, key: str, order: str, symbol: str, least: int) -> DataFrame:
    """``left, right, i, run``: for each position of the left sequence the longest run, of ``least`` or more, that starts there."""
    return common_runs(df, key, order, symbol, least, each=True)


def sharing(df: DataFrame, key: str, order: str, symbol: str, least: int, last: str | None = None) -> DataFrame:
    """``left, right``: pairs of sequences that have a run of ``least`` symbols in common.

    With ``last``, a column that is the same in all rows of a key, a row's key stands for the keys up to ``last``:
    pairs are those with ``left`` below the right one's ``last``, so a key of several meets itself too.
    """
    g = ngrams(df, key, order, symbol, range(least, least + 1)).select(key, "gram").distinct()
    if last is not None:
        g = g.join(small_side(df.select(key, last).distinct()), key)
    return meeting(g, key, "gram", last).select("left", "right").distinct()


def meeting(rows: DataFrame, key: str, on: str, last: str | None = None) -> DataFrame:
    """``left, right`` and ``on``: pairs of keys that share a value; values of many keys are dealt out in blocks."""
    a, b = rows.select(F.col(key).alias("left"), on), rows.select(F.col(key).alias("right"), on, F.col(last or key).alias("_last"))
    return dealt_join(a, b, on, ["left"], ["right"]).filter("left < _last").drop("_last")


def analysis_windows(df: DataFrame, key: str, duration: str, width: float = 10.0, hop: float = 5.0, shortest: float = 1.0) -> DataFrame:
    """``key, w_start, w_end``: windows every ``hop`` seconds, closed at the end; a last stub falls away unless alone."""
    d = F.col(duration)
    n = F.greatest(F.ceil((d - width) / hop).cast("int") + 1, F.lit(1))
    w = df.filter(d > 0).select(key, d.alias("_d"), n.alias("_n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("_k"))
    w = w.withColumn("w_start", F.col("_k") * hop).withColumn("w_end", F.least(F.col("w_start") + width, F.col("_d")))
    stub = (F.col("_d") - F.col("w_start") < shortest) & (F.col("_n") > 1)
    return w.filter(~stub).select(key, F.col("w_start").cast("double").alias("w_start"), F.col("w_end").cast("double").alias("w_end"))


def loudest_window(df: DataFrame, key: str, order: str, amplitude: str, rows: int) -> DataFrame:
    """``key, start_pos, energy``: the first of the windows of ``rows`` rows with the most energy."""
    w = Window.partitionBy(key).orderBy(order)
    a = F.col(amplitude)
    df = df.withColumn("_e", F.sum(a * a).over(w.rowsBetween(0, rows - 1))).withColumn("_n", F.count("*").over(w.rowsBetween(0, rows - 1)))
    best = Window.partitionBy(key).orderBy(F.desc("energy"), "start_pos")
    full = df.filter(F.col("_n") == rows).select(key, F.col(order).alias("start_pos"), F.round("_e", 6).alias("energy"))
    return full.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")


def density_cap(df: DataFrame, key: str, bucket: str, rank_by: list, most: int) -> DataFrame:
    w = Window.partitionBy(key, bucket).orderBy(*rank_by)
    return df.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= most)


def local_maxima(df: DataFrame, key: str, order: list[str], value: str, reach: int, floor: float) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-reach, reach)
    return df.withColumn("_m", F.max(value).over(w)).filter((F.col(value) == F.col("_m")) & (F.col(value) > floor)).drop("_m")


def centred_median(df: DataFrame, key: str, order: list[str], value: str, reach: int = 2) -> DataFrame:
    """Median of 2*reach+1 rows; at the ends the first and last value stand for those beyond."""
    w = Window.partitionBy(key).orderBy(*order)
    first, last = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    around = [F.coalesce(F.lag(value, k).over(w), first) for k in range(reach, 0, -1)] + [F.col(value)] + [F.coalesce(F.lead(value, k).over(w), last) for k in range(1, reach + 1)]
    return df.withColumn("smooth", F.get(F.array_sort(F.array(*around)), F.lit(reach)))


def cumulative(df: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(w))


def local_slopes(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Slope from each point to the next, NULL where x stands still, and over the whole path."""
    w = Window.partitionBy(key).orderBy(x, y)
    dx, dy = F.lead(x).over(w) - F.col(x), F.lead(y).over(w) - F.col(y)
    out = df.withColumn("slope", F.when(dx != 0, dy / dx))
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    span = F.last(x).over(full) - F.first(x).over(full)
    return out.withColumn("path_slope", F.when(span != 0, (F.last(y).over(full) - F.first(y).over(full)) / span))


def snapped(df: DataFrame, grid: DataFrame, key: str, time: str, beat: str) -> DataFrame:
    """Each time with the nearest grid point of its key, a tie going to the earlier: two as-of lookups in one sort."""
    both = df.select(key, F.col(time).alias("t"), F.lit(None).cast("double").alias("g"), F.lit(1).alias("_kind")).unionAll(
        grid.select(key, F.col(beat).alias("t"), F.col(beat).alias("g"), F.lit(0).alias("_kind")))
    w = Window.partitionBy(key)
    earlier = F.last("g", True).over(w.orderBy("t", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    later = F.last("g", True).over(w.orderBy(F.desc("t"), "_kind").rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("_a", earlier).withColumn("_b", later).filter("_kind = 1")
    near = F.when(F.col("_b").isNull() | (F.col("t") - F.col("_a") <= F.col("_b") - F.col("t")), F.col("_a")).otherwise(F.col("_b"))
    return out.select(key, F.col("t").alias(time), near.alias(beat))


def contained(items: DataFrame, spans: DataFrame, key: str, start: str, end: str, width: float) -> DataFrame:
    """The rows of ``items`` that lie wholly in one of the ``spans`` of their key.

    A range join made an equi-join on buckets of ``width``: an item stands under the bucket of its start, a span
    under all that it touches.
    """
    i = items.withColumn("_b", F.floor(F.col(start) / width))
    s = spans.select(F.col(key), F.col(start).alias("_s"), F.col(end).alias("_e"), F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))).alias("_b"))
    return i.alias("i").join(s.alias("s"), (F.col(f"i.{key}") == F.col(f"s.{key}")) & (F.col("i._b") == F.col("s._b")) & (F.col(f"i.{start}") >= F.col("_s")) & (F.col(f"i.{end}") <= F.col("_e")), "left_semi").drop("_b")
