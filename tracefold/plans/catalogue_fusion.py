"""Queries from measurements to verdicts, rights, calibration and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import predicates as pr
from ..functions import rights
from ..operators import calibration, fusion, matching, sampling
from . import engine
from .adapters import candidates, catalogue, measurements, read, rounded, scores, tracks, with_

SIZE = 150
FEATURES = ["peak", "qmax", "coverage", "jaccard", "semantic"]
WEIGHTS, BIAS = {"peak": 1.5, "qmax": 2.0, "coverage": 0.75, "jaccard": -0.5, "semantic": 0.25, "has_jaccard": 0.1, "has_semantic": -0.2}, -1.25


def q15(spark, d):
    m = measurements(spark, d)
    return m.groupBy("supplier").agg(F.count_if(pr.grid_eligible(F.col("qmax"), F.col("peak"))).alias("eligible"), F.count("*").alias("n"))


def q31(spark, d):
    m = measurements(spark, d)
    g = pr.gate(F.coalesce(F.col("coverage"), F.lit(0.0)), F.col("qmax") < 0.9, F.col("run"))
    return m.groupBy(g.alias("decision")).agg(F.count("*").alias("n"))


def q32(spark, d):
    m = measurements(spark, d).withColumn("rule_class", fusion.decide())
    return m.groupBy("rule_class", "lyrics_status").agg(F.count("*").alias("n"), F.sum("line").alias("lines"))


def _verdicts(spark, d):
    return fusion.verdicts(measurements(spark, d), SIZE)


def q33(spark, d):
    v = _verdicts(spark, d)
    return v.groupBy("rule_class", "verdict_class", "layer").agg(F.count("*").alias("n"), F.count_if(F.col("mean_idf").isNull()).alias("abstained"))


def q34(spark, d):
    v = _verdicts(spark, d)
    return v.groupBy("verdict_class").agg(F.count("probability").alias("scored"), rounded(F.avg("probability")).alias("mean"), rounded(F.max("probability")).alias("top"))


def q35(spark, d):
    v = _verdicts(spark, d).join(candidates(spark, d), F.col("supplier") == F.col("candidate"))
    legal = fusion.assess(F.col("verdict_class"), F.col("license"), F.col("artist"), F.col("title"), F.col("semitones"), F.col("tempo"), F.col("peak"))
    v = v.select("query", "line", "supplier", "verdict_class", "license", legal.alias("legal"))
    return v.groupBy("verdict_class", "license", F.array_join("legal.rights_layers", ",").alias("layers"), F.array_join("legal.flags", ",").alias("flags")).agg(
        F.count("*").alias("n"), rounded(F.sum("legal.modification"), 4).alias("modification"), rounded(F.sum("legal.recognizability"), 4).alias("recognizability"))


def q36(spark, d):
    c = candidates(spark, d)
    return c.select("candidate", rights.licence_name(F.col("license")).alias("licence"), rights.attribution(F.col("artist"), F.col("title"), F.col("license")).alias("attribution"), pr.open_licence(F.col("license")).alias("open"))


def q37(spark, d):
    return engine.ranking(_verdicts(spark, d), candidates(spark, d), 20).select("query", "candidate", "rank")


def q38(spark, d):
    m = measurements(spark, d)
    run = F.when(F.col("supplier") % 17 == 0, "failed").otherwise("ok")
    return m.groupBy(fusion.evidence_status(run, F.col("lyrics_status")).alias("lyrics"), fusion.evidence_status(run, F.when(F.col("peak").isNotNull(), "ok")).alias("fingerprint")).agg(F.count("*").alias("n"))


def q39(spark, d):
    m = measurements(spark, d)
    span = F.when(F.col("span_len") > 20, F.struct(F.lit(0.0).alias("start"), F.col("span_len").alias("end")))
    block = fusion.alignment_block(span, span, F.when(F.col("has_transform"), F.col("semitones")), F.when(F.col("has_transform"), F.col("tempo")))
    out = m.select("query", "line", "supplier", block.alias("b"))
    return out.groupBy("supplier").agg(F.count("b").alias("aligned"), F.count("b.query_span").alias("spans"), rounded(F.sum("b.query_span.end")).alias("seconds"), rounded(F.sum("b.tempo_ratio")).alias("tempo"))


def q40(spark, d):
    m = measurements(spark, d).groupBy("query", "supplier").agg(F.max("peak").alias("peak"), F.max("line").alias("line"))
    first, second = m.filter("line <= 4"), m.filter("line >= 3").withColumn("peak", F.col("peak") + 100.0)
    u = matching.upsert(first, second, ["query", "supplier"])
    return u.groupBy("supplier").agg(F.count("*").alias("n"), rounded(F.sum("peak"), 4).alias("peak"))


def q41(spark, d):
    return engine.manifest_violations(candidates(spark, d))


def q42(spark, d):
    return sampling.qualifying(sampling.groups(catalogue(spark, d))).select("work_title", "n_total", "n_vocal", "n_languages")


def q43(spark, d):
    return sampling.singletons(sampling.groups(catalogue(spark, d))).select("work_title", "n_vocal")


def q44(spark, d):
    c = catalogue(spark, d)
    return sampling.positive_pairs(c, sampling.qualifying(sampling.groups(c)), 7, 40)


def q45(spark, d):
    c = catalogue(spark, d)
    return sampling.hard_negatives(c, q44(spark, d), "performer", 7)


def q46(spark, d):
    m = measurements(spark, d)
    x = calibration.design(m.select("query", *FEATURES), FEATURES, calibration.feature_means(m, FEATURES))
    return x.groupBy((F.col("query") % 50).alias("bucket")).agg(*(rounded(F.avg(c)).alias(c) for c in FEATURES), F.sum("has_jaccard").alias("has_jaccard"), F.sum("has_peak").alias("has_peak"))


def q47(spark, d):
    m = measurements(spark, d)
    x = calibration.design(m.select("query", *FEATURES), FEATURES, calibration.feature_means(m, FEATURES))
    p = calibration.linear_score(WEIGHTS, BIAS)
    return x.groupBy((F.col("query") % 50).alias("bucket")).agg(rounded(F.avg(p)).alias("score"))


def q48(spark, d):
    curve = calibration.reliability(scores(spark, d), "p", "y")
    ece = calibration.calibration_error(curve)
    return curve.crossJoin(F.broadcast(ece)).select("bin", "n", rounded(F.col("predicted")).alias("predicted"), rounded(F.col("observed")).alias("observed"), rounded(F.col("ece")).alias("ece"))


def q49(spark, d):
    return calibration.operating_threshold(scores(spark, d), "p", "y", 0.86).select(rounded(F.col("threshold")).alias("threshold"))


def q50(spark, d):
    a = calibration.auc(scores(spark, d), "p", "y")
    return a.select(rounded(F.col("auc")).alias("auc"), "auc_defined").crossJoin(F.broadcast(calibration.precision_at(scores(spark, d), "p", "y", 0.5))).select("auc", "auc_defined", rounded(F.col("precision")).alias("precision"), "alarms")


def q51(spark, d):
    v = measurements(spark, d).select(fusion.decide().alias("a"), fusion.decide(monotone=True).alias("b"))
    return calibration.confusion(v, "a", "b")


def q53(spark, d):
    t = tracks(spark, d)
    w = Window.partitionBy("track", "symbol").orderBy(F.desc("t"), F.desc("event_id"))
    latest = t.withColumn("r", F.row_number().over(w)).filter("r = 1")
    seen = t.groupBy("track").agg(F.max(F.col("symbol") == "purchase").alias("finished"))
    return latest.join(seen, "track").select("track", "symbol", "event_id", rounded(F.col("amp")).alias("amp"), "finished")


#: Messages of the query below (fixed values).
MESSAGES = ("HTTP Error 429: Too Many Requests", "Video unavailable", "The uploader has not made this video available; not available in your country", "timed out while reading", "HTTP Error 503: x", "something else", "HTTP Error 404: gone", "Private video")


def q54(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.element_at(F.array(*map(F.lit, MESSAGES)), (F.col("o_orderkey") % 8 + 1).cast("int")).alias("m"))
    return o.groupBy(pr.error_reason(F.col("m")).alias("reason")).agg(F.count("*").alias("n"))


def q58(spark, d):
    dated = candidates(spark, d).filter("published is not null and published_source is not null")
    day = F.datediff(F.to_date("published"), F.to_date(F.lit("1950-01-01")))
    w = Window.partitionBy("license").orderBy("day", "candidate")
    g = dated.withColumn("day", day).withColumn("gap", F.col("day") - F.lag("day").over(w))
    top = F.max("gap").over(Window.partitionBy("license"))
    return g.select("license", "candidate", "published", F.col("gap").cast("long").alias("gap"), rounded(14 + 74 * F.col("gap") / top, 4).alias("px"))


def q61(spark, d):
    return engine.summary(engine.analyze(measurements(spark, d), candidates(spark, d), SIZE))


def q66(spark, d):
    c = candidates(spark, d).select("candidate", F.element_at(F.array(*map(F.lit, ("bytes=0-99", "bytes=500-", "bytes=-200", "bytes=900-100", "items=1-2", "bytes=5000-"))), (F.col("candidate") % 6 + 1).cast("int")).alias("header"))
    r = rights.byte_range(F.col("header"), F.lit(1000).cast("long"))
    return c.select("candidate", r.alias("r")).select("candidate", "r.start", "r.end")


def q67(spark, d):
    m = measurements(spark, d)
    return m.select("query", "line", "supplier", rounded(rights.span_percent(F.col("semitones"), F.col("span_len"), F.lit(40.0))).alias("share"), rounded(rights.window_step(F.col("span_len"), F.col("line"))).alias("step"),
                    rounded(rights.candidate_position(F.col("span_len"), F.lit(30.0), F.col("tempo"))).alias("position"), rights.clock_text(F.col("span_len") * 7).alias("clock"))


def q68(spark, d):
    """Fetch report: results a category, and what a target with overshoot asks for."""
    o = read(spark, d, "orders").select(pr.error_reason(F.element_at(F.array(*map(F.lit, MESSAGES)), (F.col("o_orderkey") % 8 + 1).cast("int"))).alias("reason"))
    n = o.groupBy("reason").agg(F.count("*").alias("attempted"))
    return n.withColumn("asked", F.ceil(F.col("attempted") * 1.25))


QUERIES = {
    "q15_grid_eligibility": q15, "q31_gate_decision": q31, "q32_verdict_cascade": q32, "q33_degradation": q33, "q34_raw_probability": q34, "q35_rights_layers_flags": q35, "q36_attribution": q36,
    "q37_ranking": q37, "q38_evidence_map": q38, "q39_alignment_block": q39, "q40_merge_upsert": q40, "q41_manifest_violations": q41, "q42_group_pool": q42, "q43_singletons": q43,
    "q44_positive_pairs": q44, "q45_hard_negatives": q45, "q46_feature_design": q46, "q47_logistic_scores": q47, "q48_reliability_ece": q48, "q49_operating_threshold": q49, "q50_auc": q50,
    "q51_confusion_matrix": q51, "q53_event_log_latest": q53, "q54_error_reason": q54, "q58_timeline_gaps": q58, "q61_analyze_end_to_end": q61, "q66_byte_ranges": q66, "q67_display_spans": q67, "q68_fetch_report": q68,
}

_REASON = "CASE o_orderkey % 8 WHEN 0 THEN 'throttled' WHEN 1 THEN 'unavailable' WHEN 2 THEN 'geoblocked' WHEN 3 THEN 'network' WHEN 4 THEN 'network' WHEN 5 THEN 'unknown' WHEN 6 THEN 'unavailable' ELSE 'unavailable' END"
_LICENCE = "CASE license WHEN 'cc-by-4.0' THEN 'CC BY 4.0' WHEN 'cc-by-nc-sa-3.0' THEN 'CC BY-NC-SA 3.0' ELSE replace(license, '_', ' ') END"
_GROUPS = """by_lang AS (SELECT work_title, language, count(*) AS n, count(*) FILTER (NOT instrumental) AS vocal FROM cat WHERE trim(work_title) <> '' GROUP BY 1, 2),
grp AS (SELECT work_title, sum(n)::BIGINT AS n_total, sum(vocal)::BIGINT AS n_vocal, count(*) FILTER (language IS NOT NULL AND vocal > 0) AS n_languages, max(vocal) AS most_vocal FROM by_lang GROUP BY 1),
pool AS (SELECT * FROM grp WHERE n_vocal BETWEEN 2 AND 10 AND most_vocal >= 2 AND (len(regexp_split_to_array(trim(work_title), '\\s+')) >= 3 OR length(work_title) >= 17))"""
_POSITIVE = """tit AS (SELECT work_title FROM pool ORDER BY sha256('7|' || work_title), work_title LIMIT 40),
voc AS (SELECT c.*, count(*) OVER (PARTITION BY c.work_title, language) AS k FROM cat c JOIN tit USING (work_title) WHERE NOT instrumental),
lng AS (SELECT *, sha256('7|' || work_title || '|' || language) AS l, sha256('7|' || performance_id::VARCHAR) AS p FROM voc WHERE k >= 2),
fst AS (SELECT *, min(l) OVER (PARTITION BY work_title) AS f FROM lng), two AS (SELECT *, row_number() OVER (PARTITION BY work_title ORDER BY p, performance_id) AS r FROM fst WHERE l = f),
pos AS (SELECT work_title, language, max(CASE WHEN r = 1 THEN performance_id END) AS a, max(CASE WHEN r = 2 THEN performance_id END) AS b FROM two WHERE r <= 2 GROUP BY 1, 2)"""
_DESIGN = """mu AS (SELECT avg(peak) AS peak, avg(qmax) AS qmax, avg(coverage) AS coverage, avg(jaccard) AS jaccard, avg(semantic) AS semantic FROM meas),
dsg AS (SELECT query % 50 AS bucket, coalesce(m.peak, mu.peak) AS peak, coalesce(m.qmax, mu.qmax) AS qmax, coalesce(m.coverage, mu.coverage) AS coverage, coalesce(m.jaccard, mu.jaccard) AS jaccard, coalesce(m.semantic, mu.semantic) AS semantic,
 (m.jaccard IS NOT NULL)::INTEGER::DOUBLE AS has_jaccard, (m.semantic IS NOT NULL)::INTEGER::DOUBLE AS has_semantic, (m.peak IS NOT NULL)::INTEGER::DOUBLE AS has_peak FROM meas m, mu)"""
_MONO = "CASE WHEN NOT has_transform AND peak > 0.6::DOUBLE AND span_len > 15 THEN 'EXACT' WHEN has_transform AND peak > 0.5::DOUBLE AND qmax > 0.5::DOUBLE THEN 'MODIFIED' WHEN peak > 0.4::DOUBLE AND span_len < 15 AND reps >= 2 THEN 'EXCERPT_PHONOGRAM' WHEN (peak IS NULL OR peak < 0.4::DOUBLE) AND qmax > 0.25::DOUBLE AND coverage > 0.5::DOUBLE THEN 'VERSION' WHEN run >= 8 AND coverage < 0.4::DOUBLE THEN 'EXCERPT_WORK' WHEN qmax < 0.4::DOUBLE AND lyrics_status = 'ok' AND jaccard > 0.5::DOUBLE THEN 'LYRICS' ELSE 'NONE' END"

ORACLES = {
    "q15_grid_eligibility": with_("measurements") + " SELECT supplier, count(*) FILTER (qmax >= 0.25::DOUBLE AND NOT coalesce(peak >= 0.5::DOUBLE, false)) AS eligible, count(*) AS n FROM meas GROUP BY supplier",
    "q31_gate_decision": with_("measurements") + " SELECT CASE WHEN coverage < 0.6::DOUBLE THEN 'asr_confidence' WHEN NOT (qmax < 0.9::DOUBLE) THEN 'language_unstable' WHEN run = 0 THEN 'no_speech' ELSE 'pass' END AS decision, count(*) AS n FROM meas GROUP BY 1",
    "q32_verdict_cascade": with_("measurements", "verdicts") + " SELECT rule_class, lyrics_status, count(*) AS n, sum(line)::BIGINT AS lines FROM rul GROUP BY 1, 2",
    "q33_degradation": with_("measurements", "verdicts") + " SELECT rule_class, verdict_class, layer, count(*) AS n, count(*) FILTER (mean_idf IS NULL) AS abstained FROM ver GROUP BY 1, 2, 3",
    "q34_raw_probability": with_("measurements", "verdicts") + " SELECT verdict_class, count(probability) AS scored, round(avg(probability), 6) AS mean, round(max(probability), 6) AS top FROM ver GROUP BY 1",
    "q35_rights_layers_flags": with_("measurements", "verdicts", "candidates") + """, x AS (SELECT v.*, c.license, v.verdict_class IN ('EXCERPT_PHONOGRAM', 'EXCERPT_WORK') AS ex,
 round_even(1 - (1 - least(abs(semitones) / 12, 1)) * (1 - least(abs(log2(tempo)), 1)), 4) AS md, CASE WHEN peak IS NOT NULL THEN least(greatest(peak, 0), 1) END AS rc, (c.license LIKE 'cc%' OR c.license LIKE 'public_domain%') AS op FROM ver v JOIN cand c ON v.supplier = c.candidate),
y AS (SELECT *, CASE WHEN ex AND NOT op AND rc >= 0.5::DOUBLE THEN 'recognizable_excerpt' END AS f1, CASE WHEN ex AND NOT op AND md >= 0.4::DOUBLE AND rc >= 0.7::DOUBLE THEN 'possible_pastiche' END AS f2 FROM x)
SELECT verdict_class, license, CASE WHEN verdict_class IN ('EXACT', 'MODIFIED', 'EXCERPT_PHONOGRAM') THEN 'phonogram,work' WHEN verdict_class = 'VERSION' THEN 'work,performance' WHEN verdict_class IN ('EXCERPT_WORK', 'LYRICS') THEN 'work' ELSE '' END AS layers,
 concat_ws(',', f1, f2) AS flags, count(*) AS n, round(sum(CASE WHEN ex THEN md END), 4) AS modification, round(sum(CASE WHEN ex THEN rc END), 4) AS recognizability FROM y GROUP BY 1, 2, 3, 4""",
    "q36_attribution": with_("candidates") + f" SELECT candidate, {_LICENCE} AS licence, artist || ', \"' || title || '\", ' || {_LICENCE} AS attribution, license LIKE 'cc%' OR license LIKE 'public_domain%' AS open FROM cand",
    "q38_evidence_map": with_("measurements") + " SELECT CASE WHEN supplier % 17 = 0 THEN 'failed' ELSE lyrics_status END AS lyrics, CASE WHEN supplier % 17 = 0 THEN 'failed' WHEN peak IS NOT NULL THEN 'ok' ELSE 'not_applicable' END AS fingerprint, count(*) AS n FROM meas GROUP BY 1, 2",
    "q39_alignment_block": with_("measurements") + " SELECT supplier, count(*) FILTER (span_len > 20 OR has_transform) AS aligned, count(*) FILTER (span_len > 20) AS spans, round(sum(CASE WHEN span_len > 20 THEN span_len END), 6) AS seconds, round(sum(CASE WHEN has_transform THEN tempo END), 6) AS tempo FROM meas GROUP BY supplier",
    "q40_merge_upsert": with_("measurements") + """, m AS (SELECT query, supplier, max(peak) AS peak, max(line) AS line FROM meas GROUP BY 1, 2), a AS (SELECT query, supplier, peak FROM m WHERE line <= 4), b AS (SELECT query, supplier, peak + 100.0::DOUBLE AS peak, true AS hit FROM m WHERE line >= 3),
u AS (SELECT coalesce(a.query, b.query) AS query, coalesce(a.supplier, b.supplier) AS supplier, CASE WHEN b.hit THEN b.peak ELSE a.peak END AS peak FROM a FULL JOIN b ON a.query = b.query AND a.supplier = b.supplier) SELECT supplier, count(*) AS n, round(sum(peak), 4) AS peak FROM u GROUP BY supplier""",
    "q41_manifest_violations": with_("candidates") + """, p AS (SELECT audio_path FROM cand GROUP BY 1 HAVING count(*) > 1)
SELECT candidate, 'R3 audio_path is not unique' AS violation FROM cand JOIN p USING (audio_path) UNION ALL SELECT candidate, 'R4 date without source' FROM cand WHERE published IS NOT NULL AND published_source IS NULL
UNION ALL SELECT candidate, 'R5 source without date' FROM cand WHERE published IS NULL AND published_source IS NOT NULL UNION ALL SELECT candidate, 'R6 date is not ISO' FROM cand WHERE published IS NOT NULL AND try_cast(published AS DATE) IS NULL
UNION ALL SELECT candidate, 'R7 audio_path outside data/audio/' FROM cand WHERE audio_path NOT LIKE 'data/audio/%' UNION ALL SELECT candidate, 'R8 instrumental with lyrics' FROM cand WHERE instrumental AND lyrics_path IS NOT NULL""",
    "q42_group_pool": with_("catalogue") + f", {_GROUPS} SELECT work_title, n_total, n_vocal, n_languages FROM pool",
    "q43_singletons": with_("catalogue") + f", {_GROUPS} SELECT work_title, n_vocal FROM grp WHERE n_total = 1",
    "q44_positive_pairs": with_("catalogue") + f", {_GROUPS}, {_POSITIVE} SELECT * FROM pos",
    "q45_hard_negatives": with_("catalogue") + f""", {_GROUPS}, {_POSITIVE}, e0 AS (SELECT *, row_number() OVER (PARTITION BY work_title ORDER BY sha256('7|' || performance_id::VARCHAR), performance_id) AS r FROM cat WHERE NOT instrumental AND work_title NOT IN (SELECT work_title FROM pos)),
e AS (SELECT *, row_number() OVER (PARTITION BY performer ORDER BY sha256('7|' || work_title), work_title) AS k FROM e0 WHERE r = 1)
SELECT performer, max(CASE WHEN k % 2 = 1 THEN performance_id END) AS a, max(CASE WHEN k % 2 = 0 THEN performance_id END) AS b FROM e GROUP BY performer, (k - 1) // 2 HAVING count(*) = 2""",
    "q46_feature_design": with_("measurements") + f", {_DESIGN} SELECT bucket, round(avg(peak), 6) AS peak, round(avg(qmax), 6) AS qmax, round(avg(coverage), 6) AS coverage, round(avg(jaccard), 6) AS jaccard, round(avg(semantic), 6) AS semantic, sum(has_jaccard) AS has_jaccard, sum(has_peak) AS has_peak FROM dsg GROUP BY bucket",
    "q47_logistic_scores": with_("measurements") + f", {_DESIGN} SELECT bucket, round(avg(1 / (1 + exp(-(-1.25::DOUBLE + peak * 1.5::DOUBLE + qmax * 2.0::DOUBLE + coverage * 0.75::DOUBLE + jaccard * -0.5::DOUBLE + semantic * 0.25::DOUBLE + has_jaccard * 0.1::DOUBLE + has_semantic * -0.2::DOUBLE)))), 6) AS score FROM dsg GROUP BY bucket",
    "q48_reliability_ece": with_("scores") + ", c AS (SELECT least(floor(p * 10), 9)::INTEGER AS bin, count(*) AS n, avg(p) AS predicted, avg(y) AS observed FROM sco GROUP BY 1), e AS (SELECT sum(n * abs(observed - predicted)) / sum(n) AS ece FROM c) SELECT bin, n, round(predicted, 6) AS predicted, round(observed, 6) AS observed, round(ece, 6) AS ece FROM c, e",
    "q49_operating_threshold": with_("scores") + ", s AS (SELECT p, avg(y) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING) AS pr FROM sco) SELECT round(least(greatest(min(p), 1e-6), 1 - 1e-6), 6) AS threshold FROM s WHERE pr >= 0.86::DOUBLE",
    "q50_auc": with_("scores") + ", r AS (SELECT y, p, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS k FROM sco), s AS (SELECT sum(CASE WHEN y = 1 THEN k END) AS r1, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0, avg(CASE WHEN p >= 0.5::DOUBLE THEN y END) AS precision, count(*) FILTER (p >= 0.5::DOUBLE) AS alarms FROM r) SELECT round((r1 - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * n0), 6) AS auc, true AS auc_defined, round(precision, 6) AS precision, alarms FROM s",
    "q51_confusion_matrix": with_("measurements", "verdicts") + f" SELECT rule_class AS truth, {_MONO} AS predicted, count(*) AS n FROM rul GROUP BY 1, 2",
    "q53_event_log_latest": with_("tracks") + ", l AS (SELECT *, row_number() OVER (PARTITION BY track, symbol ORDER BY t DESC, event_id DESC) AS r FROM trk), s AS (SELECT track, bool_or(symbol = 'purchase') AS finished FROM trk GROUP BY track) SELECT l.track, symbol, event_id, round(amp, 6) AS amp, finished FROM l JOIN s ON l.track = s.track WHERE r = 1",
    "q54_error_reason": f"SELECT {_REASON} AS reason, count(*) AS n FROM orders GROUP BY 1",
    "q58_timeline_gaps": with_("candidates") + """, g AS (SELECT license, candidate, published, date_diff('day', DATE '1950-01-01', published::DATE) AS day FROM cand WHERE published IS NOT NULL AND published_source IS NOT NULL),
h AS (SELECT *, day - lag(day) OVER (PARTITION BY license ORDER BY day, candidate) AS gap FROM g) SELECT license, candidate, published, gap::BIGINT AS gap, round(14 + 74::DOUBLE * gap / max(gap) OVER (PARTITION BY license), 4) AS px FROM h""",
    "q61_analyze_end_to_end": with_("measurements", "verdicts", "candidates") + """, x AS (SELECT v.*, c.license, v.verdict_class IN ('EXCERPT_PHONOGRAM', 'EXCERPT_WORK') AS ex, (c.license LIKE 'cc%' OR c.license LIKE 'public_domain%') AS op, CASE WHEN peak IS NOT NULL THEN least(greatest(peak, 0), 1) END AS rc FROM ver v JOIN cand c ON v.supplier = c.candidate)
SELECT verdict_class, layer, license, count(*) AS n, round(avg(probability), 6) AS probability, count(*) FILTER (ex AND NOT op AND rc >= 0.5::DOUBLE) AS flagged FROM x GROUP BY 1, 2, 3""",
    "q66_byte_ranges": """SELECT s_suppkey AS candidate, CASE s_suppkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 500 WHEN 2 THEN 800 WHEN 4 THEN 0 END::BIGINT AS start, CASE s_suppkey % 6 WHEN 0 THEN 99 WHEN 1 THEN 999 WHEN 2 THEN 999 WHEN 4 THEN 999 END::BIGINT AS "end" FROM supplier""",
    "q67_display_spans": with_("measurements") + """ SELECT query, line, supplier, round(CASE WHEN span_len IS NOT NULL THEN 100 * greatest(least(greatest(span_len, 0), 40) - least(greatest(semitones, 0), 40), 0) / 40 END, 6) AS share, round(CASE WHEN line > 1 AND span_len > 10 THEN (span_len - 10) / (line - 1) END, 6) AS step,
 round(CASE WHEN span_len IS NULL THEN NULL ELSE greatest(0, span_len + tempo - 30) END, 6) AS position, CASE WHEN span_len IS NOT NULL THEN ((span_len * 7)::BIGINT // 60)::VARCHAR || ':' || lpad(((span_len * 7)::BIGINT % 60)::VARCHAR, 2, '0') END AS clock FROM meas""",
    "q68_fetch_report": f"SELECT {_REASON} AS reason, count(*) AS attempted, ceil(count(*) * 1.25::DOUBLE)::BIGINT AS asked FROM orders GROUP BY 1",
}
