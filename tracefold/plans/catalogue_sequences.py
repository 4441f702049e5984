"""Queries over ordered sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import music
from ..operators import commonality, sequences
from .adapters import numbered, rounded, tracks, with_

SIZES = range(3, 6)
MELODIC = range(4, 9)


def _folded(spark: SparkSession, d: str) -> DataFrame:
    return sequences.fold_repeats(tracks(spark, d), "track", ["t", "event_id"], "symbol")


def _ngrams(spark: SparkSession, d: str) -> DataFrame:
    return sequences.ngrams(_folded(spark, d), "track", "pos", "symbol", SIZES)


def _frequencies(spark: SparkSession, d: str) -> DataFrame:
    return sequences.document_frequency(_ngrams(spark, d), "track", "gram", "n")


def q01(spark, d):
    return _folded(spark, d).select("track", "pos", "event_id", "symbol")


def q02(spark, d):
    return _frequencies(spark, d)


def _known(spark, d):
    size = tracks(spark, d).agg(F.countDistinct("track").alias("n"))
    f = _frequencies(spark, d).select("gram", "df")
    return commonality.with_idf(_ngrams(spark, d), f, size, ["gram"])


def q03(spark, d):
    return _known(spark, d).select("gram", "df", rounded(F.col("idf")).alias("idf"), "is_common").distinct()


def q04(spark, d):
    c = commonality.commonality(_known(spark, d), "track")
    return c.select("track", "n_patterns", rounded(F.col("mean_idf")).alias("mean_idf"), "corpus_frequency")


def q05(spark, d):
    f = sequences.fold_repeats(tracks(spark, d), "track", ["t", "event_id"], "chord")
    g = sequences.ngrams(f, "track", "pos", "chord", range(3, 4)).withColumn("degrees", F.array_join(music.degrees(F.split("gram", " ")), " "))
    return sequences.document_frequency(g, "track", "degrees")


def q06(spark, d):
    s = sequences.intervals(numbered(tracks(spark, d)), "track", "pos", "pitch")
    return s.groupBy("step").agg(F.count("*").alias("n"))


def q07(spark, d):
    s = sequences.intervals(numbered(tracks(spark, d)), "track", "pos", "pitch")
    g = sequences.ngrams(s, "track", "pos", "step", range(4, 5))
    return sequences.document_frequency(g, "track", "gram").filter("df > 1")


def q08(spark, d):
    """Longest common runs of folded event types, from the eight symbols on that count as evidence."""
    f = _folded(spark, d).select("track", "pos", "symbol")
    return sequences.longest_common_runs(f, "track", "pos", "symbol", 8)


def q09(spark, d):
    s = sequences.intervals(numbered(tracks(spark, d)), "track", "pos", "pitch")
    g = sequences.ngrams(s, "track", "pos", "step", MELODIC).select("track", F.struct("n", "gram").alias("phrase")).distinct()
    return sequences.meeting(g, "track", "phrase").groupBy("left", "right").agg(F.max("phrase.n").alias("longest"), F.count("*").alias("shared"))


def q16(spark, d):
    t = tracks(spark, d).withColumn("hour", F.floor(F.col("t") / 86400))
    return sequences.density_cap(t, "track", "hour", [F.desc("amp"), F.asc("event_id")], 2).select("track", "hour", "event_id", "rank")


def q17(spark, d):
    return sequences.local_maxima(tracks(spark, d), "track", ["t", "event_id"], "amp", 2, 1.0).select("track", "event_id", rounded(F.col("amp")).alias("amp"))


def q19(spark, d):
    m = sequences.centred_median(tracks(spark, d), "track", ["t", "event_id"], "amp")
    return m.select("track", "event_id", rounded(F.col("smooth")).alias("smooth"))


def _durations(spark, d):
    return tracks(spark, d).groupBy("track").agg(((F.max("t") - F.min("t")) / 86400 * 2).alias("duration"))


def q20(spark, d):
    w = sequences.analysis_windows(_durations(spark, d), "track", "duration")
    return w.select("track", rounded(F.col("w_start")).alias("w_start"), rounded(F.col("w_end")).alias("w_end"))


def q21(spark, d):
    return sequences.loudest_window(numbered(tracks(spark, d)), "track", "pos", "amp", 5)


def q55(spark, d):
    s = numbered(tracks(spark, d)).withColumn("bucket", F.floor((F.col("pos") - 1) / 8)).groupBy("track", "bucket").agg(F.max(F.abs("amp")).alias("peak"))
    top = s.groupBy("track").agg(F.max("peak").alias("top"))
    return s.join(top, "track").select("track", "bucket", rounded(F.when(F.col("top") > 0, F.col("peak") / F.col("top")).otherwise(0.0)).alias("peak"))


def q56(spark, d):
    s = sequences.local_slopes(numbered(tracks(spark, d)).select("track", "pos", "pitch"), "track", "pos", "pitch")
    return s.select("track", "pos", rounded(F.col("slope")).alias("slope"), rounded(F.col("path_slope")).alias("path_slope"))


def q62(spark, d):
    s = sequences.intervals(numbered(tracks(spark, d)), "track", "pos", "pitch")
    return sequences.cumulative(s, "track", ["pos"], "step", "contour").select("track", "pos", "contour")


def q63(spark, d):
    t = tracks(spark, d).withColumn("t_end", F.col("t"))
    i = sequences.islands(t, "track", ["t", "event_id"], "symbol", "t", "t_end")
    return i.select("track", "island", "symbol", rounded(F.col("t")).alias("t"), rounded(F.col("t_end")).alias("t_end"), "n")


def q64(spark, d):
    t = tracks(spark, d).groupBy("track").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    grid = t.select("track", F.explode(F.transform(F.sequence(F.lit(0), F.lit(60)), lambda k: F.col("a") + k * (F.col("b") - F.col("a")) / 60)).alias("beat"))
    s = sequences.snapped(tracks(spark, d), grid, "track", "t", "beat")
    return s.select("track", rounded(F.col("t")).alias("t"), rounded(F.col("beat"), 4).alias("beat"))


QUERIES = {
    "q01_fold_repeats": q01, "q02_chord_ngram_df": q02, "q03_pattern_idf_common": q03, "q04_mean_idf_per_track": q04, "q05_chord_degrees": q05, "q06_intervals": q06,
    "q07_interval_ngrams": q07, "q08_longest_common_run": q08, "q09_shared_ngrams_longest": q09, "q16_density_cap": q16, "q17_local_maxima": q17, "q19_median_smooth": q19,
    "q20_analysis_windows": q20, "q21_window_energy_argmax": q21, "q55_waveform_peaks": q55, "q56_path_slopes": q56, "q62_interval_contour": q62, "q63_merge_islands": q63, "q64_snap_to_grid": q64,
}

_STEPS = "stp AS (SELECT * FROM (SELECT track, pos, lead(pitch) OVER (PARTITION BY track ORDER BY pos) - pitch AS step FROM seq) WHERE step IS NOT NULL)"
_IDF = "siz AS (SELECT count(DISTINCT track) AS n FROM trk), fr AS (SELECT gram, count(*) AS df FROM (SELECT DISTINCT track, gram FROM ng) GROUP BY gram), known AS (SELECT track, ng.gram, fr.df, ln(siz.n / greatest(fr.df, 1)::DOUBLE) AS idf FROM ng JOIN fr ON ng.gram = fr.gram, siz)"

ORACLES = {
    "q01_fold_repeats": with_("tracks", "folded") + " SELECT track, pos, event_id, symbol FROM fld",
    "q02_chord_ngram_df": with_("tracks", "folded", "ngrams") + " SELECT gram, n, count(*) AS df FROM (SELECT DISTINCT track, gram, n FROM ng) GROUP BY gram, n",
    "q03_pattern_idf_common": with_("tracks", "folded", "ngrams") + f", {_IDF} SELECT DISTINCT gram, df, round(idf, 6) AS idf, idf < ln(1 / 0.01::DOUBLE) AS is_common FROM known",
    "q04_mean_idf_per_track": with_("tracks", "folded", "ngrams") + f", {_IDF} SELECT track, count(*) AS n_patterns, round(avg(idf), 6) AS mean_idf, max(df) AS corpus_frequency FROM known GROUP BY track",
    "q05_chord_degrees": with_("tracks") + """, f0 AS (SELECT *, lag(chord) OVER (PARTITION BY track ORDER BY t, event_id) AS before FROM trk),
f AS (SELECT track, chord, row_number() OVER (PARTITION BY track ORDER BY t, event_id) AS pos FROM f0 WHERE before IS NULL OR before <> chord),
g AS (SELECT track, chord AS a, lead(chord, 1) OVER w AS b, lead(chord, 2) OVER w AS c FROM f WINDOW w AS (PARTITION BY track ORDER BY pos)),
m AS (SELECT * FROM (VALUES ('C', 0, ''), ('G', 7, ''), ('Am', 9, 'm'), ('F', 5, '')) v(ch, pc, md)),
dg AS (SELECT g.track, CASE WHEN x.pc IS NULL OR y.pc IS NULL OR z.pc IS NULL THEN a || ' ' || b || ' ' || c
 ELSE '0' || x.md || ' ' || ((y.pc - x.pc + 12) % 12)::VARCHAR || y.md || ' ' || ((z.pc - x.pc + 12) % 12)::VARCHAR || z.md END AS degrees
 FROM g LEFT JOIN m x ON a = x.ch LEFT JOIN m y ON b = y.ch LEFT JOIN m z ON c = z.ch WHERE c IS NOT NULL)
SELECT degrees, count(*) AS df FROM (SELECT DISTINCT track, degrees FROM dg) GROUP BY degrees""",
    "q06_intervals": with_("tracks") + f", {_STEPS} SELECT step, count(*) AS n FROM stp GROUP BY step",
    "q07_interval_ngrams": with_("tracks") + f""", {_STEPS}, g AS (SELECT track, step AS a, lead(step, 1) OVER w AS b, lead(step, 2) OVER w AS c, lead(step, 3) OVER w AS d FROM stp WINDOW w AS (PARTITION BY track ORDER BY pos))
SELECT gram, count(*) AS df FROM (SELECT DISTINCT track, a::VARCHAR || ' ' || b::VARCHAR || ' ' || c::VARCHAR || ' ' || d::VARCHAR AS gram FROM g WHERE d IS NOT NULL) GROUP BY gram HAVING count(*) > 1""",
    "q08_longest_common_run": with_("tracks", "folded") + """, hits AS (SELECT a.track AS "left", b.track AS "right", a.pos AS i, a.pos - b.pos AS d FROM fld a JOIN fld b ON a.symbol = b.symbol AND a.track < b.track),
isl AS (SELECT *, i - row_number() OVER (PARTITION BY "left", "right", d ORDER BY i) AS island FROM hits), runs AS (SELECT "left", "right", count(*) AS run FROM isl GROUP BY "left", "right", d, island)
SELECT "left", "right", max(run) AS run FROM runs GROUP BY "left", "right" HAVING max(run) >= 8""",
    "q09_shared_ngrams_longest": with_("tracks") + f", {_STEPS}, g AS (SELECT track, step::VARCHAR AS s0, " + ", ".join(f"(lead(step, {k}) OVER w)::VARCHAR AS s{k}" for k in range(1, 8)) + " FROM stp WINDOW w AS (PARTITION BY track ORDER BY pos)), u AS ("
    + " UNION ".join(f"SELECT track, {n} AS n, {" || ' ' || ".join(f's{k}' for k in range(n))} AS gram FROM g WHERE s{n - 1} IS NOT NULL" for n in MELODIC)
    + """) SELECT x.track AS "left", y.track AS "right", max(x.n) AS longest, count(*) AS shared FROM u x JOIN u y ON x.n = y.n AND x.gram = y.gram AND x.track < y.track GROUP BY x.track, y.track""",
    "q16_density_cap": with_("tracks") + """, r AS (SELECT track, floor(t / 86400)::BIGINT AS hour, event_id, row_number() OVER (PARTITION BY track, floor(t / 86400) ORDER BY amp DESC, event_id) AS rank FROM trk) SELECT * FROM r WHERE rank <= 2""",
    "q17_local_maxima": with_("tracks") + """, m AS (SELECT track, event_id, amp, max(amp) OVER (PARTITION BY track ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS top FROM trk) SELECT track, event_id, round(amp, 6) AS amp FROM m WHERE amp = top AND amp > 1""",
    "q19_median_smooth": with_("tracks") + """, e AS (SELECT track, event_id, pos, amp, first_value(amp) OVER w AS f, last_value(amp) OVER w AS l, lag(amp, 1) OVER o AS b1, lag(amp, 2) OVER o AS b2, lead(amp, 1) OVER o AS a1, lead(amp, 2) OVER o AS a2 FROM seq
 WINDOW w AS (PARTITION BY track ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), o AS (PARTITION BY track ORDER BY pos))
SELECT track, event_id, round(list_sort([coalesce(b2, f), coalesce(b1, f), amp, coalesce(a1, l), coalesce(a2, l)])[3], 6) AS smooth FROM e""",
    "q20_analysis_windows": with_("tracks") + """, dur AS (SELECT track, (max(t) - min(t)) / 86400 * 2 AS d FROM trk GROUP BY track), n AS (SELECT track, d, greatest(ceil((d - 10) / 5)::INTEGER + 1, 1) AS n FROM dur WHERE d > 0),
w AS (SELECT track, d, n, unnest(range(0, n)) * 5.0::DOUBLE AS s FROM n) SELECT track, round(s, 6) AS w_start, round(least(s + 10, d), 6) AS w_end FROM w WHERE NOT (d - s < 1 AND n > 1)""",
    "q21_window_energy_argmax": with_("tracks") + """, e AS (SELECT track, pos AS start_pos, round(sum(amp * amp) OVER w, 6) AS energy, count(*) OVER w AS n FROM seq WINDOW w AS (PARTITION BY track ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
r AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY energy DESC, start_pos) AS k FROM e WHERE n = 5) SELECT track, start_pos, energy FROM r WHERE k = 1""",
    "q55_waveform_peaks": with_("tracks") + """, b AS (SELECT track, ((pos - 1) // 8)::BIGINT AS bucket, max(abs(amp)) AS peak FROM seq GROUP BY 1, 2) SELECT track, bucket, round(peak / max(peak) OVER (PARTITION BY track), 6) AS peak FROM b""",
    "q56_path_slopes": with_("tracks") + """, s AS (SELECT track, pos, (lead(pitch) OVER o - pitch)::DOUBLE / (lead(pos) OVER o - pos) AS slope, last_value(pitch) OVER f - first_value(pitch) OVER f AS dy, last_value(pos) OVER f - first_value(pos) OVER f AS dx FROM seq
 WINDOW o AS (PARTITION BY track ORDER BY pos), f AS (PARTITION BY track ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT track, pos, round(slope, 6) AS slope, round(CASE WHEN dx <> 0 THEN dy::DOUBLE / dx END, 6) AS path_slope FROM s""",
    "q62_interval_contour": with_("tracks") + f", {_STEPS} SELECT track, pos, (sum(step) OVER (PARTITION BY track ORDER BY pos))::BIGINT AS contour FROM stp",
    "q63_merge_islands": with_("tracks") + """, c AS (SELECT *, CASE WHEN lag(symbol) OVER (PARTITION BY track ORDER BY t, event_id) = symbol THEN 0 ELSE 1 END AS ch FROM trk), g AS (SELECT *, sum(ch) OVER (PARTITION BY track ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS island FROM c)
SELECT track, island::BIGINT AS island, any_value(symbol) AS symbol, round(min(t), 6) AS t, round(max(t), 6) AS t_end, count(*) AS n FROM g GROUP BY track, island""",
    "q64_snap_to_grid": with_("tracks") + """, x AS (SELECT track, min(t) AS a, max(t) AS b FROM trk GROUP BY track), g AS (SELECT track, a + k * (b - a) / 60 AS beat FROM x, (SELECT unnest(range(0, 61)) AS k)),
p AS (SELECT s.event_id, s.track, s.t, g.beat, row_number() OVER (PARTITION BY s.event_id ORDER BY round(abs(s.t - g.beat), 9), g.beat) AS r FROM trk s JOIN g ON s.track = g.track) SELECT track, round(t, 6) AS t, round(beat, 4) AS beat FROM p WHERE r = 1""",
}
