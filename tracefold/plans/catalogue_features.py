"""Queries over evidence, the stored index, calibrated scores, negatives, melodies and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rights
from ..functions import text as tx
from ..operators import calibration, fusion, pairs, sampling
from ..operators.hash_index import HashIndex
from ..storage import is_small, materialised, shared_folder, small_side
from ..thresholds import threshold
from .adapters import candidates, catalogue, measurements, read, rounded, text_hashes, tracks, with_
from .analysis import statuses
from .detectors import Lyrics, spans_with_idf

SIZE = 150


def q94(spark, d):
    """Statuses of every supplier for every line number, from measurements that exist for some of them."""
    m = measurements(spark, d).withColumn("query", F.col("line")).withColumnRenamed("supplier", "candidate")
    everyone = candidates(spark, d).select("candidate").join(F.broadcast(m.select("query").distinct()))
    absent = read(spark, d, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("candidate"), F.lit("audio_missing").alias("reason"))
    found = m.groupBy("query", "candidate").agg(F.max("peak").alias("peak"), F.max("qmax").alias("qmax"))
    reason = lambda status: F.when(status == "failed", F.lit("ValueError")).cast("string")
    harmonic = F.when(F.col("qmax") > 0.9, "ok").otherwise("failed")
    given = {"fingerprint": (found.filter("peak > 0.9").select("query", "candidate", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("reason")), "no alignment"),
             "harmonic": (found.filter("qmax > 0.5").select("query", "candidate", harmonic.alias("status"), reason(harmonic).alias("reason")), "filtered out"), "lyrics": (found, "unused"), "melodic": (None, "unused")}
    rows = statuses(everyone, absent, {"fingerprint": ("ok", None), "harmonic": ("ok", None), "lyrics": ("gated", "asr_confidence")}, given)
    return rows.groupBy("query", "detector", "status", "reason").agg(F.count("*").alias("n"), F.min("candidate").alias("first"))


def q95(spark, d):
    """Benchmark items against a stored index of the documents' word trigrams: every eleventh document is replaced by its beginning, every seventh removed."""
    c = text_hashes(spark, d, "documents", "doc_id").select(F.col("key").alias("candidate"), F.xxhash64("h").alias("h"), "t")
    index = HashIndex(spark, shared_folder(spark, "index"), ("long", "long"), buckets=int(spark.conf.get("spark.sql.shuffle.partitions")), longest=50_000)
    index.add(c)
    index.add(c.filter("candidate % 11 = 0 and t < 40"))
    index.remove(read(spark, d, "documents").filter("doc_id % 7 = 0").select(F.col("doc_id").alias("candidate")))
    q = text_hashes(spark, d, "benchmark", "item_id").select(F.col("key").alias("query"), "i", F.xxhash64("h").alias("h"), "t")
    return index.hits(q).groupBy("query", "candidate").agg(F.count("*").alias("hits"), F.countDistinct("i").alias("matched"), F.min("dt").alias("least"), F.max("dt").alias("most"))


def q96(spark, d):
    """Hard negatives of all titles: one pair a performer, then a language, each work once."""
    c = catalogue(spark, d)
    taken = c.filter("performance_id % 10 = 0").select("work_title")
    return sampling.matched_negatives(c, taken, 42)


#: A model of each of two classes, as if trained (fixed values of the query).
MODELS = {
    "EXACT": calibration.Model("EXACT", ("peak", "qmax", "coverage"), (0.5, 0.4, 0.5), (2.0, 1.0, 0.5), (0.25, 0.5, 0.0), -2.0, 400),
    "VERSION": calibration.Model("VERSION", ("qmax", "semantic", "mean_idf"), (0.4, 0.6, 4.0), (3.0, 1.5, -0.25), (0.0, -0.5, 0.125), -1.0, 300),
    "LYRICS": calibration.Model("LYRICS", ("jaccard",), (0.5,), (9.0,), (0.0,), 0.0, 10),
}


def q97(spark, d):
    """Verdicts with calibrated probabilities, by class and bin of the probability."""
    v = calibration.calibrated(fusion.verdicts(measurements(spark, d), SIZE), MODELS)
    bin_ = F.floor(F.col("probability") * 20).cast("long").alias("bin")
    return v.groupBy("verdict_class", "probability_status", bin_).agg(F.count("*").alias("n"), rounded(F.avg("probability"), 9).alias("probability"))


def q98(spark, d):
    """The tracks' dominant lines on a grid of quarter days, and their intervals."""
    t = tracks(spark, d).withColumn("s", F.col("t") / 86400)
    rows = t.groupBy("track").agg(F.array_sort(F.collect_list(F.struct("s", "event_id", "pitch"))).alias("e"), F.floor(F.min("s")).alias("a"), F.ceil(F.max("s")).alias("b"))
    grid = F.transform(F.sequence(F.col("a") * 4, F.col("b") * 4), lambda k: k / 4)
    notes = rows.select("track", F.transform("e", lambda x: x["s"]).alias("starts"), F.transform("e", lambda x: x["s"] + 0.4).alias("ends"), F.transform("e", lambda x: x["pitch"].cast("double")).alias("pitches"), grid.alias("grid"))
    m = pairs.melodies(notes, "track")
    return m.select("track", F.size("line").cast("long").alias("notes"), F.aggregate("line", F.lit(0.0), lambda s, x: s + x["end"] - x["start"]).alias("days"), F.md5(F.array_join("intervals", ",")).alias("digest"))


def tokens(spark, d, table, key) -> DataFrame:
    """``key, w``: the tokens of each text, made once."""
    t = tx.computed(read(spark, d, table).select(key, "text"), "w", tx.tokens(F.coalesce("text", F.lit(""))))
    return materialised(t.select(key, "w"), "tokens")


def runs_among(rows, key, n, wanted, name, separator) -> DataFrame:
    """``key, name``: the different runs of ``n`` tokens of each row that are among ``wanted``, which is joined if it is large."""
    if is_small(wanted):
        return pairs.wanted_runs(rows, key, "w", n, wanted, name, separator)
    return rows.select(key, F.explode(F.array_distinct(tx.array_ngrams(F.col("w"), n, separator))).alias(name)).join(wanted, name, "left_semi")


def common_texts(items: DataFrame, docs: DataFrame) -> DataFrame:
    """``query, candidate, a, b``: tokens of items and documents that share a run of five words."""
    grams = items.select("item_id", F.explode(F.array_distinct(tx.array_ngrams(F.col("w"), 5, " "))).alias("g"))
    shared = runs_among(docs, "doc_id", 5, materialised(grams.select("g").distinct(), "grams"), "g", " ")
    met = materialised(shared.join(small_side(grams), "g").select(F.col("item_id").alias("query"), F.col("doc_id").alias("candidate")).distinct(), "met")
    a, b = items.select(F.col("item_id").alias("query"), F.col("w").alias("a")), docs.select(F.col("doc_id").alias("candidate"), F.col("w").alias("b"))
    return b.join(small_side(met), "candidate").join(a, "query")


def q99(spark, d):
    """Spans that items and documents have in common, with the idf of their three-word shingles among the documents."""
    docs = tokens(spark, d, "documents", "doc_id")
    found = materialised(Lyrics.spans(common_texts(tokens(spark, d, "benchmark", "item_id"), docs)), "spans")
    wanted = materialised(found.select(F.explode("patterns").alias("pattern")).distinct(), "patterns")
    frequencies = runs_among(docs, "doc_id", 3, wanted, "pattern", "\x1f").groupBy("pattern").agg(F.count("*").alias("df"))
    spans = spans_with_idf(found, (frequencies, docs.count()), ["query_from", "candidate_from", "words", "query_len", "candidate_len"])
    each = spans.select("query", "candidate", F.explode("spans").alias("s"))
    return each.groupBy("query", "candidate").agg(F.count("*").alias("spans"), F.sum("s.words").alias("words"), F.max("s.words").alias("longest"), rounded(F.avg("s.idf")).alias("idf"))


def q72(spark, d):
    """How many measurements each limit of the cascade lets through, where it stands, and how close the nearest ones are."""
    limits = {"EXACT_PEAK_RATIO": "peak", "MODIFIED_PEAK_RATIO": "peak", "EXCERPT_PEAK_RATIO": "peak", "VERSION_MAX_PEAK_RATIO": "peak", "EXACT_MIN_SPAN_S": "span_len", "MODIFIED_QMAX": "qmax", "VERSION_QMAX": "qmax",
              "LYRICS_MAX_QMAX": "qmax", "VERSION_COVERAGE": "coverage", "EXCERPT_WORK_MAX_COVERAGE": "coverage", "VERSION_SEMANTIC_SIM": "semantic", "LYRICS_JACCARD": "jaccard"}
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(float(threshold(n))).alias("threshold"), F.col(c).alias("x")) for n, c in limits.items())))
    rows = measurements(spark, d).select(each.alias("m")).select("m.*")
    over = F.col("x") > F.col("threshold")
    return rows.groupBy("name", "threshold").agg(F.count("x").alias("measured"), F.count_if(over).alias("above"), rounded(F.min(F.when(over, F.col("x")))).alias("least_above"), rounded(F.max(F.when(~over, F.col("x")))).alias("most_below"))


def q100(spark, d):
    """Where the points of each track's events stand on a scattered picture."""
    e = read(spark, d, "events").select("event_id", rights.scatter(F.col("event_id"), F.col("user_id")).alias("place"))
    return e.select("event_id", rounded(F.col("place")).alias("place"))


def q101(spark, d):
    """The whole calibration sample of the catalogue: positives, then negatives from single performances."""
    return sampling.sample_pairs(catalogue(spark, d), 40, 40, 42)


QUERIES = {"q94_evidence_statuses": q94, "q95_stored_index": q95, "q96_matched_negatives": q96, "q97_calibrated_verdicts": q97, "q98_quantised_melody": q98, "q99_text_spans": q99, "q72_thresholds": q72, "q100_scatter": q100, "q101_calibration_sample": q101}


def _score(model: calibration.Model) -> str:
    terms = [f"CASE WHEN {c} IS NULL THEN {m}::DOUBLE ELSE {c} END * {w}::DOUBLE + CASE WHEN {c} IS NULL THEN 0.0::DOUBLE ELSE {f}::DOUBLE END" for c, m, w, f in zip(model.features, model.means, model.weights, model.flags, strict=True)]
    return f"1 / (1 + exp(-({model.bias}::DOUBLE + {' + '.join(terms)})))"


ORACLES = {
    "q94_evidence_statuses": with_("measurements", "candidates") + """, every AS (SELECT candidate, query FROM cand, (SELECT DISTINCT line AS query FROM meas)),
gone AS (SELECT s_suppkey AS candidate FROM supplier WHERE s_acctbal < 0), fnd AS (SELECT line AS query, supplier AS candidate, max(peak) AS peak, max(qmax) AS qmax FROM meas GROUP BY 1, 2),
e AS (SELECT every.query, every.candidate, gone.candidate IS NOT NULL AS lost, peak, qmax FROM every LEFT JOIN gone USING (candidate) LEFT JOIN fnd ON fnd.query = every.query AND fnd.candidate = every.candidate),
s AS (SELECT query, candidate, lost, 'fingerprint' AS detector, CASE WHEN peak > 0.9::DOUBLE THEN 'ok' WHEN lost THEN 'failed' ELSE 'not_applicable' END AS status, CASE WHEN peak > 0.9::DOUBLE THEN NULL ELSE 'no alignment' END AS why FROM e
 UNION ALL SELECT query, candidate, lost, 'harmonic', CASE WHEN qmax > 0.9::DOUBLE THEN 'ok' WHEN qmax > 0.5::DOUBLE OR lost THEN 'failed' ELSE 'not_applicable' END, CASE WHEN qmax > 0.9::DOUBLE THEN NULL WHEN qmax > 0.5::DOUBLE THEN 'ValueError' ELSE 'filtered out' END FROM e
 UNION ALL SELECT query, candidate, lost, 'lyrics', 'gated', 'asr_confidence' FROM e UNION ALL SELECT query, candidate, lost, 'melodic', 'not_applicable', 'the detector was not run' FROM e)
SELECT query, detector, status, CASE WHEN status <> 'ok' AND lost THEN 'audio_missing' ELSE why END AS reason, count(*) AS n, min(candidate) AS first FROM s GROUP BY 1, 2, 3, 4""",
    "q95_stored_index": with_("words", "hashes") + """ SELECT query, candidate, count(*) AS hits, count(DISTINCT i) AS matched, min(dt) AS least, max(dt) AS most FROM hit
WHERE candidate % 7 <> 0 AND (candidate % 11 <> 0 OR dt + qt < 40) GROUP BY 1, 2""",
    "q97_calibrated_verdicts": with_("measurements", "verdicts") + f""", c AS (SELECT verdict_class, CASE WHEN verdict_class IN ('EXACT', 'VERSION') THEN 'calibrated' ELSE 'uncalibrated' END AS probability_status,
 CASE verdict_class WHEN 'EXACT' THEN {_score(MODELS['EXACT'])} WHEN 'VERSION' THEN {_score(MODELS['VERSION'])} ELSE probability END AS p FROM ver)
SELECT verdict_class, probability_status, floor(p * 20)::BIGINT AS bin, count(*) AS n, round(avg(p), 9) AS probability FROM c GROUP BY 1, 2, 3""",
    "q100_scatter": """WITH a AS (SELECT event_id, xor((event_id + 1)::HUGEINT * 2654435761 % 4294967296, (user_id + 1)::HUGEINT * 2246822507 % 4294967296) AS x FROM events),
b AS (SELECT event_id, xor(x, x // 32768) * 3266489909 % 4294967296 AS x FROM a) SELECT event_id, round((xor(x, x // 8192) % 100000)::DOUBLE / 100000.0::DOUBLE, 6) AS place FROM b""",
    "q72_thresholds": with_("measurements") + """, lim(name, threshold, c) AS (VALUES ('EXACT_PEAK_RATIO', 0.6::DOUBLE, 'peak'), ('MODIFIED_PEAK_RATIO', 0.5, 'peak'), ('EXCERPT_PEAK_RATIO', 0.4, 'peak'), ('VERSION_MAX_PEAK_RATIO', 0.4, 'peak'), ('EXACT_MIN_SPAN_S', 15, 'span_len'),
 ('MODIFIED_QMAX', 0.5, 'qmax'), ('VERSION_QMAX', 0.25, 'qmax'), ('LYRICS_MAX_QMAX', 0.4, 'qmax'), ('VERSION_COVERAGE', 0.5, 'coverage'), ('EXCERPT_WORK_MAX_COVERAGE', 0.4, 'coverage'), ('VERSION_SEMANTIC_SIM', 0.7, 'semantic'), ('LYRICS_JACCARD', 0.5, 'jaccard')),
m AS (SELECT name, threshold, CASE c WHEN 'peak' THEN peak WHEN 'span_len' THEN span_len WHEN 'qmax' THEN qmax WHEN 'coverage' THEN coverage WHEN 'semantic' THEN semantic ELSE jaccard END AS x FROM meas, lim)
SELECT name, threshold, count(x) AS measured, count(*) FILTER (x > threshold) AS above, round(min(x) FILTER (x > threshold), 6) AS least_above, round(max(x) FILTER (x <= threshold), 6) AS most_below FROM m GROUP BY 1, 2""",
}
