"""Queries over verdict events, contracts, JSON and display helpers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import predicates as pr
from ..functions import rights
from ..functions import text as tx
from ..operators import fusion, pairs
from ..operators.joins import dealt_join
from ..storage import is_small, materialised
from .adapters import candidates, measurements, read, rounded, tracks, with_

SIZE = 150


def _top(spark, d, **options):
    v = fusion.verdicts(measurements(spark, d), SIZE, **options)
    best = v.groupBy("query").agg(F.max(F.struct(F.coalesce("probability", F.lit(-1.0)).alias("p"), F.col("verdict_class").alias("c"))).alias("b"))
    return best.select("query", F.col("b.c").alias("cls"), F.when(F.col("b.p") >= 0, F.col("b.p")).alias("probability"))


def q60(spark, d):
    """Verdict events of both levels; the second carries the class of the first."""
    first, final = _top(spark, d, monotone=True), _top(spark, d)
    one = first.select("query", F.lit(1).alias("level"), F.lit("partial").alias("status"), "cls", rounded(F.col("probability")).alias("probability"), F.lit(None).cast("string").alias("previous"))
    two = final.join(first.select("query", F.col("cls").alias("previous")), "query", "left").select("query", F.lit(2).alias("level"), F.lit("final").alias("status"), "cls", rounded(F.col("probability")).alias("probability"), "previous")
    return one.unionByName(two)


def signed(spark, d, table, key, permutations=128):
    """``key, s``: MinHash signatures of three-word shingles, computed once."""
    rows = tx.computed(read(spark, d, table).select(key, "text"), "w", tx.words(F.col("text")))
    rows = tx.computed(rows.select(key, "w"), "g", F.array_distinct(tx.array_ngrams(F.col("w"), 3, " "))).filter(F.size("g") > 0)
    return materialised(pairs.minhashes(rows, key, "g", permutations, "s"), "signatures")


def banded(signatures, key, permutations=128):
    """``key, band``: hashes of each two places; the signatures stay behind."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(permutations // 2 - 1)), lambda b: F.xxhash64(b, F.get("s", 2 * b), F.get("s", 2 * b + 1)))
    return signatures.select(key, F.explode(bands).alias("band"))


def q73(spark, d):
    """Estimated Jaccard similarity of every benchmark item with the documents that agree with it in a band."""
    a, b = signed(spark, d, "benchmark", "item_id"), signed(spark, d, "documents", "doc_id")
    x, y = banded(a, "item_id"), banded(b, "doc_id")
    both = y.join(F.broadcast(x), "band") if is_small(x) else dealt_join(y, x, "band", ["doc_id"], ["item_id"])
    met = materialised(both.select("item_id", "doc_id").distinct(), "met")
    scored = met.join(a.withColumnRenamed("s", "sa"), "item_id").join(b.withColumnRenamed("s", "sb"), "doc_id")
    return scored.select("item_id", "doc_id", rounded(tx.estimated_jaccard(F.col("sa"), F.col("sb"))).alias("estimate"))


def q74(spark, d):
    n = tracks(spark, d).groupBy("track", "symbol").agg(F.count("*").alias("c"))
    return n.groupBy("track").agg(rounded(F.max("c") / F.sum("c")).alias("share"), F.sum("c").alias("n"))


def q75(spark, d):
    """Results that hold numbers although their status is not ok."""
    m = measurements(spark, d).withColumn("status", F.when(F.col("supplier") % 17 == 0, "failed").otherwise("ok"))
    return m.filter(pr.carries_claim(F.col("status"), F.col("peak"), F.col("jaccard"))).groupBy("supplier").agg(F.count("*").alias("violations"))


def q76(spark, d):
    """Envelopes through JSON: NULL fields leave no key."""
    m = measurements(spark, d).select("query", "line", "supplier", F.to_json(F.struct("peak", "jaccard", F.col("lyrics_status").alias("status"))).alias("j"))
    back = m.withColumn("b", F.from_json("j", "peak double, jaccard double, status string"))
    return back.groupBy("b.status").agg(F.count("b.peak").alias("peaks"), F.count("b.jaccard").alias("jaccards"), F.count_if(F.col("j").contains("jaccard")).alias("keys"), rounded(F.sum("b.peak"), 4).alias("peak"))


def q77(spark, d):
    """Earliest dated candidate of each licence, by the ISO string."""
    w = Window.partitionBy("license").orderBy("published", "candidate")
    return candidates(spark, d).filter("published is not null").withColumn("r", F.row_number().over(w)).filter("r = 1").select("license", "candidate", "published")


def q78(spark, d):
    m = measurements(spark, d)
    return m.select("query", "line", "supplier", rights.percent_text(F.col("coverage")).alias("coverage"), rights.mistakes_per_hundred(F.col("qmax")).cast("long").alias("mistakes"), F.md5(fusion.explanation(fusion.decide())).alias("explained"))


def q79(spark, d):
    """Sliding windows of ten days every five over the events, by event time."""
    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    n = e.groupBy(F.window("ts", "10 days", "5 days"), "event_type").agg(F.count("*").alias("n"))
    return n.select(F.date_format("window.start", "yyyy-MM-dd").alias("start"), "event_type", "n")


QUERIES = {"q60_verdict_events": q60, "q73_minhash_estimate": q73, "q74_dominant_share": q74, "q75_contract_violations": q75, "q76_json_envelopes": q76, "q77_earliest_dated": q77, "q78_texts": q78, "q79_sliding_windows": q79}

_TOP = "SELECT query, max({p: coalesce(probability, -1.0::DOUBLE), c: verdict_class}) AS b FROM %s GROUP BY query"
_MONO = "CASE WHEN NOT has_transform AND peak > 0.6::DOUBLE AND span_len > 15 THEN 'EXACT' WHEN has_transform AND peak > 0.5::DOUBLE AND qmax > 0.5::DOUBLE THEN 'MODIFIED' WHEN peak > 0.4::DOUBLE AND span_len < 15 AND reps >= 2 THEN 'EXCERPT_PHONOGRAM' WHEN (peak IS NULL OR peak < 0.4::DOUBLE) AND qmax > 0.25::DOUBLE AND coverage > 0.5::DOUBLE THEN 'VERSION' WHEN run >= 8 AND coverage < 0.4::DOUBLE THEN 'EXCERPT_WORK' WHEN qmax < 0.4::DOUBLE AND lyrics_status = 'ok' AND jaccard > 0.5::DOUBLE THEN 'LYRICS' ELSE 'NONE' END"
_NUMBER = "CASE WHEN {0} IS NULL THEN 'no measurement' ELSE printf('%.2f', {0}) END"

ORACLES = {
    "q60_verdict_events": with_("measurements", "verdicts") + f""", m0 AS (SELECT *, {_MONO} AS mono FROM meas), m1 AS (SELECT *, CASE WHEN mono IN ('VERSION', 'LYRICS', 'EXCERPT_WORK') AND coalesce(mean_idf < ln(1 / 0.01::DOUBLE), false) THEN 'COMMON' ELSE mono END AS verdict_class FROM m0),
m2 AS (SELECT query, verdict_class, CASE WHEN verdict_class IN ('EXACT', 'MODIFIED', 'EXCERPT_PHONOGRAM') THEN peak WHEN verdict_class IN ('VERSION', 'COMMON') THEN qmax WHEN verdict_class = 'LYRICS' THEN jaccard WHEN verdict_class = 'EXCERPT_WORK' THEN run::DOUBLE / greatest(run::DOUBLE, 8.0::DOUBLE) ELSE greatest(peak, qmax) END AS probability FROM m1),
f AS ({_TOP % 'm2'}), l AS ({_TOP % 'ver'})
SELECT query, 1 AS level, 'partial' AS status, b.c AS cls, round(CASE WHEN b.p >= 0 THEN b.p END, 6) AS probability, NULL::VARCHAR AS previous FROM f
UNION ALL SELECT l.query, 2, 'final', l.b.c, round(CASE WHEN l.b.p >= 0 THEN l.b.p END, 6), f.b.c FROM l LEFT JOIN f ON l.query = f.query""",
    "q74_dominant_share": with_("tracks") + ", n AS (SELECT track, symbol, count(*) AS c FROM trk GROUP BY 1, 2) SELECT track, round(max(c)::DOUBLE / sum(c)::DOUBLE, 6) AS share, sum(c)::BIGINT AS n FROM n GROUP BY track",
    "q75_contract_violations": with_("measurements") + " SELECT supplier, count(*) AS violations FROM meas WHERE supplier % 17 = 0 AND (peak IS NOT NULL OR jaccard IS NOT NULL) GROUP BY supplier",
    "q76_json_envelopes": with_("measurements") + " SELECT lyrics_status AS status, count(peak) AS peaks, count(jaccard) AS jaccards, count(jaccard) AS keys, round(sum(peak), 4) AS peak FROM meas GROUP BY 1",
    "q77_earliest_dated": with_("candidates") + ", r AS (SELECT *, row_number() OVER (PARTITION BY license ORDER BY published, candidate) AS r FROM cand WHERE published IS NOT NULL) SELECT license, candidate, published FROM r WHERE r = 1",
    "q78_texts": with_("measurements", "verdicts") + f" SELECT query, line, supplier, printf('%.0f%%', round_even(coverage * 100, 0)) AS coverage, round((1 - qmax) * 100)::BIGINT AS mistakes, md5('Class ' || rule_class || '. peak ratio ' || {_NUMBER.format('peak')} || '. qmax ' || {_NUMBER.format('qmax')} || '. coverage ' || {_NUMBER.format('coverage')}) AS explained FROM rul",
    "q79_sliding_windows": """WITH e AS (SELECT event_type, ts, time_bucket(INTERVAL '5 days', ts, TIMESTAMP '1970-01-01') AS b FROM events), w AS (SELECT event_type, b AS s FROM e UNION ALL SELECT event_type, b - INTERVAL '5 days' FROM e) SELECT strftime(s, '%Y-%m-%d') AS start, event_type, count(*) AS n FROM w GROUP BY 1, 2""",
}
