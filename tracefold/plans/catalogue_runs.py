"""Queries over runs, entries and sources: what surrounds the measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources, streaming
from ..functions import music
from ..functions import predicates as pr
from ..operators import calibration, fusion, sampling, sequences
from . import analysis, catalogue_fusion, engine
from .adapters import candidates, measurements, read, rounded, tracks, with_


def q80(spark, d):
    """Events that lie wholly within six hours of a purchase of their track."""
    w = tracks(spark, d).select("track", "event_id", "symbol", F.col("t").alias("start"), (F.col("t") + 600).alias("end"))
    spans = w.filter("symbol = 'purchase'").select("track", (F.col("start") - 21600).alias("start"), (F.col("start") + 21600).alias("end"))
    return sequences.contained(w, spans, "track", "start", "end", 21600.0).groupBy("track").agg(F.count("*").alias("inside"))


def q81(spark, d):
    """A journal's last entry decides; what failed or never ran is still to do."""
    log = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("seq"), F.when(F.col("l_returnflag") == "R", "failed").otherwise("ok").alias("status"), "l_partkey", "l_suppkey")
    done = sampling.first_by_key(log.withColumn("_o", -F.col("seq")), "job", "_o", "l_partkey", "l_suppkey", "status").filter("status = 'ok'")
    todo = sources.pending(read(spark, d, "orders").select(F.col("o_orderkey").alias("job"), "o_orderpriority"), done, "job")
    return todo.groupBy("o_orderpriority").agg(F.count("*").alias("jobs"))


def _statuses(spark, d):
    return measurements(spark, d).withColumn("run_status", F.when(F.col("supplier") % 17 == 0, "failed").otherwise("ok"))


def q82(spark, d):
    """Stage headers: the highest number that may be read, by supplier."""
    m = _statuses(spark, d)
    m = m.withColumn("x", pr.readable(F.col("run_status"), F.col("lyrics_status"), F.col("jaccard")))
    return m.groupBy("supplier").agg(F.max("x").alias("readable"), calibration.highest(m, "lyrics_status", "semantic").alias("highest"))


def q83(spark, d):
    """Who reaches the lyrics detector: instrumentals do not, and a missing file has one name."""
    c = candidates(spark, d)
    there = c.filter("candidate % 3 <> 1").select("audio_path")
    c = sources.with_urls(c, there, "/audio/")
    status = F.when(F.col("instrumental"), "not_applicable").when(F.col("lyrics_path").isNull(), "not_applicable").otherwise("ok")
    reason = F.when(F.col("url").isNull(), analysis.AUDIO_MISSING).when(F.col("instrumental"), "instrumental").when(F.col("lyrics_path").isNull(), "no_lyrics")
    return c.select("candidate", status.alias("status"), reason.alias("reason"), "url")


def q84(spark, d):
    """Shortlists of three: harmonic results, else fingerprints, else everybody."""
    m = engine.dealt(measurements(spark, d), "query").groupBy("query", "supplier").agg(F.max("qmax").alias("qmax"), F.max("peak").alias("peak"), F.min("lyrics_status").alias("low"))
    m = m.withColumn("harmonic", F.when((F.col("query") % 5 != 0) & (F.col("low") == "ok"), "ok").otherwise("failed")).withColumn("fingerprint", F.when(F.col("peak") > 0.5, "ok"))
    return engine.shortlisted(m, "query", "harmonic", "fingerprint", [F.desc("qmax"), F.col("supplier")], 3).select("query", "supplier", "harmonic", "fingerprint")


def q85(spark, d):
    """Every candidate with its result and the word that the stream has for it."""
    results = _statuses(spark, d).groupBy(F.col("supplier").alias("candidate")).agg(F.max("peak").alias("peak")).filter("candidate % 4 <> 0").withColumn("status", F.when(F.col("candidate") % 7 == 0, "failed").when(F.col("candidate") % 7 == 1, "gated").otherwise("ok"))
    c = engine.with_results(candidates(spark, d).select("candidate"), results, "candidate")
    return c.select("candidate", "status", streaming.stage_status(F.col("status")).alias("stage"), F.when(F.col("status") == "ok", rounded(F.col("peak"))).alias("peak"))


def q86(spark, d):
    """Scalars of signals: log frequencies, costs of intervals, lengths of spans, patterns as keys."""
    p = read(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("f"), (F.col("p_partkey") % 9).cast("double").alias("x"), "p_type")
    return p.select("p_partkey", rounded(music.log_frequency(F.col("f"))).alias("log_frequency"), rounded(music.replacement_cost(F.col("x"), F.col("f") % 9)).alias("cost"),
                    F.array_join(F.transform(F.split("p_type", " "), lambda w: w.cast("string")), "\x1f").alias("pattern"))


def q87(spark, d):
    """Keys of artifacts: path, time, size and parameters."""
    text = sources.parameter_text(hop=512, frame=2048, rate=22050)
    c = candidates(spark, d)
    return c.select("candidate", sources.artifact_key(F.lit("fp"), F.lit(text), F.col("audio_path"), (F.col("candidate") * 1000).cast("string")).alias("artifact"))


def q88(spark, d):
    """Pages as fetch items: ids from their addresses, messages as reasons."""
    p = read(spark, d, "pages")
    message = F.concat(F.lit("\x1b[0;31mERROR:\x1b[0m [generic]  page "), F.col("page_id").cast("string"), F.lit(":\n  "), F.col("html"))
    p = p.withColumn("video_id", F.lit(" "))
    return p.select("page_id", sources.url_identifier(F.col("url")).alias("id"), sources.first_given("video_id", "url").alias("source"), F.length(sources.reason_text(message)).cast("long").alias("reason_length"))


def q89(spark, d):
    """Catalogue rows cleaned as those of a file are."""
    p = read(spark, d, "part")
    raw = p.select(F.concat(F.lit(" "), F.col("p_partkey").cast("string")).alias("performance_id"), F.col("p_name").alias("performance_title"), F.concat("p_brand", F.lit("  ")).alias("performer"),
                   F.when(F.col("p_size") % 3 == 0, " ").otherwise("en ").alias("language"), F.element_at(F.array(*map(F.lit, (" Yes", "0", "TRUE ", "no", ""))), (F.col("p_size") % 5 + 1).cast("int")).alias("instrumental"),
                   F.lit("").alias("youtube_url"), F.when(F.col("p_partkey") % 10 == 0, "  ").otherwise(F.col("p_type")).alias("work_title"))
    return sources.performances(raw).groupBy("work_title", "language", "instrumental").agg(F.count("*").alias("n"), F.min("performer").alias("performer"))


def q90(spark, d):
    """Verdicts by whether their class may have a model: two classes are refused, others have one for half the suppliers."""
    v = fusion.verdicts(measurements(spark, d), catalogue_fusion.SIZE)
    return v.groupBy("verdict_class", calibration.model_status(F.col("verdict_class"), F.col("supplier") % 2 == 0).alias("calibration")).agg(F.count("*").alias("n"))


def q91(spark, d):
    """Confidence and stability of tracks read as transcripts: mean probability of words, share of the main language."""
    t = tracks(spark, d).withColumn("p", F.least(F.greatest(F.col("amp") / 100, F.lit(0.0)), F.lit(1.0)))
    words = t.groupBy("track").agg(F.array_sort(F.collect_list(F.struct("event_id", F.round("p", 6).alias("probability")))).alias("words"), F.collect_list("symbol").alias("windows"))
    heard = words.select("track", rounded(analysis.word_confidence(F.col("words"))).alias("confidence"), analysis.language_stable(F.col("windows"), 0.3).alias("stable"), F.size("words").alias("n"))
    return heard.select("track", "confidence", "stable", pr.gate(F.col("confidence"), F.col("stable"), F.col("n")).alias("decision"))


def q92(spark, d):
    """Pages over a size cap are oversized, not fetched."""
    cap = 2000
    p = read(spark, d, "pages").select("page_id", F.octet_length("html").alias("size"))
    return p.select("page_id", F.when(F.col("size") > cap, "oversized").otherwise("ok").alias("status"), F.when(F.col("size") <= cap, F.col("size")).cast("long").alias("bytes"))


def q93(spark, d):
    """A calibration sample: positive and negative pairs, a fetch item of each performance once."""
    positive = catalogue_fusion.q44(spark, d).select(F.lit("positive").alias("kind"), "a", "b")
    both = positive.unionByName(catalogue_fusion.q45(spark, d).select(F.lit("negative").alias("kind"), "a", "b"))
    items = both.select("kind", F.explode(F.array("a", "b")).alias("id"))
    return sampling.first_by_key(items.withColumn("_o", (F.col("kind") != "positive").cast("int")), "id", "_o").select("id", "kind")


QUERIES = {
    "q80_contained_words": q80, "q81_journal_pending": q81, "q82_stage_headers": q82, "q83_lyrics_routing": q83, "q84_shortlist_fallback": q84, "q85_results_and_stages": q85, "q86_signal_scalars": q86,
    "q87_artifact_keys": q87, "q88_fetch_items": q88, "q89_catalogue_rows": q89, "q90_model_status": q90, "q91_transcript_gate": q91, "q92_size_cap": q92, "q93_sample_items": q93,
}

_NEGATIVE = catalogue_fusion.ORACLES["q45_hard_negatives"]

ORACLES = {
    "q80_contained_words": with_("tracks") + """ SELECT w.track, count(*) AS inside FROM trk w WHERE EXISTS (SELECT 1 FROM trk p WHERE p.track = w.track AND p.symbol = 'purchase' AND w.t >= p.t - 21600 AND w.t + 600 <= p.t + 21600) GROUP BY w.track""",
    "q81_journal_pending": """WITH r AS (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'ok' END) AS k FROM lineitem), done AS (SELECT l_orderkey FROM r WHERE k = 1 AND l_returnflag <> 'R')
SELECT o_orderpriority, count(*) AS jobs FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM done) GROUP BY 1""",
    "q82_stage_headers": with_("measurements") + " SELECT supplier, max(CASE WHEN supplier % 17 <> 0 AND lyrics_status = 'ok' THEN jaccard END) AS readable, max(CASE WHEN lyrics_status = 'ok' THEN semantic END) AS highest FROM meas GROUP BY supplier",
    "q83_lyrics_routing": with_("candidates") + """, f AS (SELECT DISTINCT audio_path FROM cand WHERE candidate % 3 <> 1), x AS (SELECT c.*, f.audio_path IS NOT NULL AS there FROM cand c LEFT JOIN f ON c.audio_path = f.audio_path)
SELECT candidate, CASE WHEN instrumental OR lyrics_path IS NULL THEN 'not_applicable' ELSE 'ok' END AS status, CASE WHEN NOT there THEN 'audio_missing' WHEN instrumental THEN 'instrumental' WHEN lyrics_path IS NULL THEN 'no_lyrics' END AS reason,
 CASE WHEN there THEN '/audio/' || audio_path END AS url FROM x""",
    "q84_shortlist_fallback": with_("measurements") + """, m AS (SELECT query, supplier, max(qmax) AS qmax, max(peak) AS peak, min(lyrics_status) AS low FROM meas GROUP BY 1, 2),
x AS (SELECT *, CASE WHEN query % 5 <> 0 AND low = 'ok' THEN 'ok' ELSE 'failed' END AS harmonic, CASE WHEN peak > 0.5::DOUBLE THEN 'ok' END AS fingerprint FROM m),
y AS (SELECT *, max((harmonic = 'ok')::INT) OVER (PARTITION BY query) AS h, max(coalesce(fingerprint = 'ok', false)::INT) OVER (PARTITION BY query) AS f FROM x),
e AS (SELECT * FROM y WHERE CASE WHEN h = 1 THEN harmonic = 'ok' WHEN f = 1 THEN fingerprint = 'ok' ELSE true END), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY qmax DESC, supplier) AS k FROM e)
SELECT query, supplier, harmonic, fingerprint FROM r WHERE k <= 3""",
    "q85_results_and_stages": with_("measurements", "candidates") + """, r AS (SELECT supplier AS candidate, max(peak) AS peak, CASE WHEN supplier % 7 = 0 THEN 'failed' WHEN supplier % 7 = 1 THEN 'gated' ELSE 'ok' END AS status FROM meas WHERE supplier % 4 <> 0 GROUP BY supplier),
x AS (SELECT c.candidate, coalesce(r.status, 'not_applicable') AS status, r.peak FROM cand c LEFT JOIN r ON c.candidate = r.candidate)
SELECT candidate, status, CASE status WHEN 'ok' THEN 'done' WHEN 'not_applicable' THEN 'skipped' ELSE status END AS stage, CASE WHEN status = 'ok' THEN round(peak, 6) END AS peak FROM x""",
    "q86_signal_scalars": "SELECT p_partkey, round(log2(p_size::DOUBLE) * 36, 6) AS log_frequency, round(least(1.0::DOUBLE, abs((p_partkey % 9)::DOUBLE - (p_size % 9)::DOUBLE) / 4), 6) AS cost, replace(p_type, ' ', chr(31)) AS pattern FROM part",
    "q87_artifact_keys": with_("candidates") + " SELECT candidate, left(sha256('fp|frame=2048;hop=512;rate=22050|' || audio_path || '|' || (candidate * 1000)::VARCHAR), 32) AS artifact FROM cand",
    "q88_fetch_items": r"""WITH m AS (SELECT page_id, url, regexp_replace(trim(regexp_replace('ERROR: [generic]  page ' || page_id::VARCHAR || ':' || chr(10) || '  ' || html, '\s+', ' ', 'g')), '^ERROR: ?', '') AS t FROM pages)
SELECT page_id, CASE WHEN regexp_extract(url, '(?:v=|youtu\.be/)([A-Za-z0-9_-]{11})', 1) <> '' THEN regexp_extract(url, '(?:v=|youtu\.be/)([A-Za-z0-9_-]{11})', 1) ELSE right(regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g'), 32) END AS id,
 trim(url) AS source, length(left(regexp_replace(t, '^\[[^\]]*\] ?', ''), 300)) AS reason_length FROM m""",
    "q89_catalogue_rows": """SELECT trim(p_type) AS work_title, CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'en' END AS language, p_size % 5 IN (0, 2) AS instrumental, count(*) AS n, min(p_brand) AS performer FROM part WHERE p_partkey % 10 <> 0 GROUP BY 1, 2, 3""",
    "q90_model_status": with_("measurements", "verdicts") + " SELECT verdict_class, CASE WHEN supplier % 2 = 0 AND verdict_class NOT IN ('LYRICS', 'EXCERPT_WORK') THEN 'calibrated' ELSE 'raw' END AS calibration, count(*) AS n FROM ver GROUP BY 1, 2",
    "q91_transcript_gate": with_("tracks") + """, c AS (SELECT track, round(avg(round(least(greatest(amp / 100, 0), 1), 6)), 6) AS confidence, count(*) AS n FROM trk GROUP BY 1), l AS (SELECT track, max(k) AS k FROM (SELECT track, symbol, count(*) AS k FROM trk GROUP BY 1, 2) GROUP BY 1),
x AS (SELECT c.track, confidence, l.k >= 0.3::DOUBLE * n AS stable, n FROM c JOIN l ON c.track = l.track) SELECT track, confidence, stable, CASE WHEN confidence < 0.6::DOUBLE THEN 'asr_confidence' WHEN NOT stable THEN 'language_unstable' ELSE 'pass' END AS decision FROM x""",
    "q92_size_cap": "SELECT page_id, CASE WHEN strlen(html) > 2000 THEN 'oversized' ELSE 'ok' END AS status, CASE WHEN strlen(html) <= 2000 THEN strlen(html) END::BIGINT AS bytes FROM pages",
    "q93_sample_items": f"""WITH neg AS ({_NEGATIVE}), po AS ({catalogue_fusion.ORACLES["q44_positive_pairs"]}), i AS (SELECT 0 AS o, unnest([a, b]) AS id FROM po UNION ALL SELECT 1, unnest([a, b]) FROM neg) SELECT id, CASE WHEN min(o) = 0 THEN 'positive' ELSE 'negative' END AS kind FROM i GROUP BY id""",
}
