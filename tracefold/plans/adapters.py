"""The test tables as artifacts of provenance analysis: tracks, texts, descriptors, catalogue, measurements.

Each adapter is a DataFrame function; ``SQL`` holds the same definitions as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Event types as chords and as pitches (fixed values of the adapter).
CHORDS = {"view": "C", "click": "G", "purchase": "Am", "signup": "F", "error": "N"}


def tracks(spark: SparkSession, d: str) -> DataFrame:
    """``track, event_id, t, symbol, chord, amp, pitch``: one row an event, ordered by (t, event_id)."""
    e = read(spark, d, "events")
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', cast(ts as timestamp_ntz)) / 1e6d")
    chord = F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v)) for k, v in CHORDS.items()))
    return e.select(F.col("user_id").alias("track"), "event_id", t.alias("t"), F.col("event_type").alias("symbol"), chord.alias("chord"), F.col("value").alias("amp"),
                    (F.pmod(F.floor(F.col("value")), F.lit(24)) + 48).cast("int").alias("pitch"))


def numbered(df: DataFrame, key: str = "track", order: tuple[str, ...] = ("t", "event_id")) -> DataFrame:
    from pyspark.sql import Window

    return df.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))


def descriptors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")


def catalogue(spark: SparkSession, d: str) -> DataFrame:
    """``performance_id, performer, work_title, instrumental, language``."""
    p = read(spark, d, "part")
    title = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(" "), "p_type")).otherwise(F.col("p_name"))
    language = F.element_at(F.array(*map(F.lit, ("en", "de", "fr", "es"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return p.select(F.col("p_partkey").alias("performance_id"), F.col("p_brand").alias("performer"), title.alias("work_title"), (F.col("p_size") % 4 == 0).alias("instrumental"), language.alias("language"))


def measurements(spark: SparkSession, d: str) -> DataFrame:
    """One row of detector measurements a line item; NULL where nothing was measured."""
    li = read(spark, d, "lineitem")
    ok = F.col("lyrics_status") == "ok"
    number = lambda c: F.col(c).cast("double")
    status = F.when(F.col("l_suppkey") % 3 == 0, "ok").when(F.col("l_suppkey") % 3 == 1, "not_applicable").otherwise("failed")
    return (li.withColumn("lyrics_status", status).select(
        F.col("l_orderkey").alias("query"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("supplier"),
        F.when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") % 7 == 0), None).otherwise(number("l_discount") * 10.0).alias("peak"),
        F.when(number("l_quantity") > 2, number("l_quantity")).alias("span_len"), F.col("l_linenumber").cast("int").alias("reps"),
        (F.col("l_returnflag") == "R").alias("has_transform"), (number("l_tax") / 0.08).alias("qmax"), ((F.col("l_partkey") % 100) / F.lit(100.0)).alias("coverage"),
        "lyrics_status", F.when(ok, (F.col("l_partkey") % 10) / F.lit(10.0)).alias("jaccard"), F.when(ok, (F.col("l_suppkey") % 20) / F.lit(20.0)).alias("semantic"),
        (F.col("l_partkey") % 13).cast("int").alias("run"), F.when(F.col("l_orderkey") % 9 != 0, (F.col("l_orderkey") % 80) / F.lit(10.0)).alias("mean_idf"),
        ((F.col("l_partkey") % 25) - 12).cast("double").alias("semitones"), (0.5 + (F.col("l_suppkey") % 16) / F.lit(10.0)).alias("tempo")))


LICENCES = ("cc-by-4.0", "cc-by-nc-sa-3.0", "public_domain", "all_rights_reserved", "unknown")


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """``candidate, artist, title, license, published`` (ISO date or NULL), ``published_source``, ``audio_path``, ``instrumental``."""
    s = read(spark, d, "supplier").join(F.broadcast(read(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    licence = F.element_at(F.array(*map(F.lit, LICENCES)), (k % 5 + 1).cast("int"))
    date = F.format_string("%d-%02d-%02d", 1950 + k % 70, 1 + k % 12, 1 + k % 28)
    return s.select(k.alias("candidate"), F.col("s_name").alias("artist"), F.concat(F.lit("Track "), F.col("n_name")).alias("title"), licence.alias("license"),
                    F.when(k % 4 != 0, date).alias("published"), F.when(k % 6 != 0, "catalogue").alias("published_source"),
                    F.concat(F.when(k % 11 == 0, "data/other/").otherwise("data/audio/"), (k % 90).cast("string"), F.lit(".wav")).alias("audio_path"), (k % 7 == 0).alias("instrumental"),
                    F.when(k % 3 == 0, F.concat(F.lit("data/lyrics/"), k.cast("string"), F.lit(".txt"))).alias("lyrics_path"))


def scores(spark: SparkSession, d: str) -> DataFrame:
    """``doc_id, y, p``: labels and calibrated-looking scores, away from bin edges."""
    docs = read(spark, d, "documents").select("doc_id", "n_chars")
    p = (F.pmod(F.col("n_chars") * 37, F.lit(997)) + 0.5) / 998.0
    return read(spark, d, "labels").filter("quality is not null").join(docs, "doc_id").select("doc_id", F.col("quality").cast("int").alias("y"), p.alias("p"))


def text_hashes(spark: SparkSession, d: str, table: str, key: str) -> DataFrame:
    """Word 3-grams as hashes, their position as time: ``key, i, h, t``."""
    from ..functions.text import array_ngrams, computed, words

    docs = computed(read(spark, d, table).select(F.col(key).alias("key"), "text"), "w", words(F.col("text")))
    rows = docs.select("key", F.posexplode(array_ngrams(F.col("w"), 3, " ")).alias("i", "h"))
    return rows.withColumn("t", F.col("i").cast("double"))


SQL = {
    "tracks": """trk AS (SELECT user_id AS track, event_id, date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) / 1e6::DOUBLE AS t, event_type AS symbol,
 CASE event_type WHEN 'view' THEN 'C' WHEN 'click' THEN 'G' WHEN 'purchase' THEN 'Am' WHEN 'signup' THEN 'F' WHEN 'error' THEN 'N' END AS chord,
 value AS amp, ((floor(value)::BIGINT % 24 + 24) % 24 + 48)::INTEGER AS pitch FROM events),
seq AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY t, event_id) AS pos FROM trk)""",
    "folded": """fld0 AS (SELECT *, lag(symbol) OVER (PARTITION BY track ORDER BY t, event_id) AS before FROM trk),
fld AS (SELECT track, event_id, t, symbol, chord, amp, pitch, row_number() OVER (PARTITION BY track ORDER BY t, event_id) AS pos FROM fld0 WHERE before IS NULL OR before <> symbol)""",
    "ngrams": """ng0 AS (SELECT track, pos, symbol AS a, lead(symbol, 1) OVER w AS b, lead(symbol, 2) OVER w AS c, lead(symbol, 3) OVER w AS d, lead(symbol, 4) OVER w AS e FROM fld WINDOW w AS (PARTITION BY track ORDER BY pos)),
ng AS (SELECT track, pos, 3 AS n, a || ' ' || b || ' ' || c AS gram FROM ng0 WHERE c IS NOT NULL
 UNION ALL SELECT track, pos, 4, a || ' ' || b || ' ' || c || ' ' || d FROM ng0 WHERE d IS NOT NULL
 UNION ALL SELECT track, pos, 5, a || ' ' || b || ' ' || c || ' ' || d || ' ' || e FROM ng0 WHERE e IS NOT NULL)""",
    "measurements": """meas0 AS (SELECT *, CASE l_suppkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'not_applicable' ELSE 'failed' END AS lyrics_status FROM lineitem),
meas AS (SELECT l_orderkey AS query, l_linenumber AS line, l_suppkey AS supplier,
 CASE WHEN l_linestatus = 'O' AND l_linenumber % 7 = 0 THEN NULL ELSE l_discount::DOUBLE * 10.0::DOUBLE END AS peak,
 CASE WHEN l_quantity > 2 THEN l_quantity::DOUBLE END AS span_len, l_linenumber::INTEGER AS reps, l_returnflag = 'R' AS has_transform, l_tax::DOUBLE / 0.08::DOUBLE AS qmax,
 (l_partkey % 100) / 100.0::DOUBLE AS coverage, lyrics_status, CASE WHEN lyrics_status = 'ok' THEN (l_partkey % 10) / 10.0::DOUBLE END AS jaccard,
 CASE WHEN lyrics_status = 'ok' THEN (l_suppkey % 20) / 20.0::DOUBLE END AS semantic, (l_partkey % 13)::INTEGER AS run,
 CASE WHEN l_orderkey % 9 <> 0 THEN (l_orderkey % 80) / 10.0::DOUBLE END AS mean_idf, ((l_partkey % 25) - 12)::DOUBLE AS semitones, 0.5::DOUBLE + (l_suppkey % 16) / 10.0::DOUBLE AS tempo FROM meas0)""",
    "verdicts": """rul AS (SELECT *, CASE
 WHEN NOT has_transform AND peak > 0.6::DOUBLE AND span_len > 15 THEN 'EXACT'
 WHEN has_transform AND peak > 0.5::DOUBLE AND qmax > 0.5::DOUBLE THEN 'MODIFIED'
 WHEN peak > 0.4::DOUBLE AND span_len < 15 AND reps >= 2 THEN 'EXCERPT_PHONOGRAM'
 WHEN (peak IS NULL OR peak < 0.4::DOUBLE) AND qmax > 0.25::DOUBLE AND coverage > 0.5::DOUBLE AND (coalesce(semantic > 0.7::DOUBLE, false) OR lyrics_status <> 'ok') THEN 'VERSION'
 WHEN run >= 8 AND coverage < 0.4::DOUBLE THEN 'EXCERPT_WORK'
 WHEN qmax < 0.4::DOUBLE AND lyrics_status = 'ok' AND jaccard > 0.5::DOUBLE THEN 'LYRICS'
 ELSE 'NONE' END AS rule_class FROM meas),
ver0 AS (SELECT *, CASE WHEN rule_class IN ('VERSION', 'LYRICS', 'EXCERPT_WORK') AND coalesce(mean_idf < ln(1 / 0.01::DOUBLE), false) THEN 'COMMON' ELSE rule_class END AS verdict_class FROM rul),
ver AS (SELECT *, CASE WHEN verdict_class IN ('EXACT', 'MODIFIED', 'EXCERPT_PHONOGRAM') THEN 'phonogram' WHEN verdict_class IN ('VERSION', 'EXCERPT_WORK', 'LYRICS') THEN 'work' END AS layer,
 CASE WHEN verdict_class IN ('EXACT', 'MODIFIED', 'EXCERPT_PHONOGRAM') THEN peak WHEN verdict_class IN ('VERSION', 'COMMON') THEN qmax WHEN verdict_class = 'LYRICS' THEN jaccard
 WHEN verdict_class = 'EXCERPT_WORK' THEN run::DOUBLE / greatest(run::DOUBLE, 8.0::DOUBLE) ELSE greatest(peak, qmax) END AS probability FROM ver0)""",
    "candidates": """cand AS (SELECT s_suppkey AS candidate, s_name AS artist, 'Track ' || n_name AS title,
 CASE s_suppkey % 5 WHEN 0 THEN 'cc-by-4.0' WHEN 1 THEN 'cc-by-nc-sa-3.0' WHEN 2 THEN 'public_domain' WHEN 3 THEN 'all_rights_reserved' ELSE 'unknown' END AS license,
 CASE WHEN s_suppkey % 4 <> 0 THEN (1950 + s_suppkey % 70)::VARCHAR || '-' || lpad((1 + s_suppkey % 12)::VARCHAR, 2, '0') || '-' || lpad((1 + s_suppkey % 28)::VARCHAR, 2, '0') END AS published,
 CASE WHEN s_suppkey % 6 <> 0 THEN 'catalogue' END AS published_source, CASE WHEN s_suppkey % 11 = 0 THEN 'data/other/' ELSE 'data/audio/' END || (s_suppkey % 90)::VARCHAR || '.wav' AS audio_path,
 s_suppkey % 7 = 0 AS instrumental, CASE WHEN s_suppkey % 3 = 0 THEN 'data/lyrics/' || s_suppkey::VARCHAR || '.txt' END AS lyrics_path
 FROM supplier JOIN nation ON s_nationkey = n_nationkey)""",
    "catalogue": """cat AS (SELECT p_partkey AS performance_id, p_brand AS performer, CASE WHEN p_size % 2 = 0 THEN p_name || ' ' || p_type ELSE p_name END AS work_title, p_size % 4 = 0 AS instrumental,
 CASE p_partkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'es' END AS language FROM part)""",
    "scores": """sco AS (SELECT l.doc_id, quality::INTEGER AS y, ((n_chars * 37) % 997 + 0.5::DOUBLE) / 998.0::DOUBLE AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE quality IS NOT NULL)""",
    "words": """wrd AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\s+'), lambda w: regexp_replace(lower(w), '[^\\p{L}\\p{N}_]+', '', 'g')), lambda w: w <> '') AS ws FROM documents),
bwr AS (SELECT item_id, list_filter(list_transform(regexp_split_to_array(text, '\\s+'), lambda w: regexp_replace(lower(w), '[^\\p{L}\\p{N}_]+', '', 'g')), lambda w: w <> '') AS ws FROM benchmark)""",
    "hashes": """dh AS (SELECT doc_id, unnest(range(0, len(ws) - 2)) AS i, unnest(list_transform(range(0, len(ws) - 2), lambda k: array_to_string(ws[k + 1:k + 3], ' '))) AS h FROM wrd WHERE len(ws) >= 3),
bh AS (SELECT item_id, unnest(range(0, len(ws) - 2)) AS i, unnest(list_transform(range(0, len(ws) - 2), lambda k: array_to_string(ws[k + 1:k + 3], ' '))) AS h FROM bwr WHERE len(ws) >= 3),
hit AS (SELECT b.item_id AS query, d.doc_id AS candidate, b.i AS i, b.i::DOUBLE AS qt, d.i::DOUBLE - b.i::DOUBLE AS dt FROM bh b JOIN dh d ON b.h = d.h)""",
}


def with_(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)


def rounded(x: Column, places: int = 6) -> Column:
    return F.round(x, places)
