"""The whole analysis: clips and candidates to rankings of two levels.

Level 1 is what signals alone say: fingerprints, harmony, the transformation grid where harmony suggests it, how
common the matched chords are. Its ranking is stored, announced and handed out before level 2 begins. Its shortlist
is all that level 2 sees: texts and melodies, which cost models. A detector that fails, as a whole or for one
candidate, leaves its measurements NULL and its status in the evidence.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..functions import kernels, music
from ..functions import predicates as pr
from ..operators import calibration, commonality, fusion, matching, pairs
from ..operators.hash_index import HashIndex
from ..streaming import STAGE
from . import detectors, engine
from .jobs import Job

AUDIO_MISSING = "audio_missing"
CHORD_SIZES = (3, 4, 5)


@dataclass
class Hooks:
    """What needs a model. Each is optional: without it the stage is ``failed`` with reason ``model_unavailable``.

    ``transcribe(clips) -> clip_id, text, words array<struct<word, probability>>, windows array<string>`` (languages
    by window), ``separate(clips) -> clips`` of voices, ``melody(clips) -> clip_id, intervals``; ``embed`` maps a
    list of sentences to a matrix. ``notes(clips) -> clip_id, starts, ends, pitches`` (arrays) is a transcription of
    notes; without a ``melody`` the dominant line of its notes on the clip's grid of beats is the melody.
    """

    transcribe: Callable[[DataFrame], DataFrame] | None = None
    separate: Callable[[DataFrame], DataFrame] | None = None
    melody: Callable[[DataFrame], DataFrame] | None = None
    embed: Callable[[list[str]], object] | None = None
    notes: Callable[[DataFrame], DataFrame] | None = None

    def sung(self) -> Callable[[DataFrame], DataFrame] | None:
        if self.melody is not None or self.notes is None:
            return self.melody
        return lambda clips: pairs.melodies(self.notes(clips).join(sources.beats_of(clips), "clip_id", "left"), "clip_id").select("clip_id", "intervals")


@dataclass
class Analysis:
    """Rankings of both levels, the measurements behind them, candidates without sound, and how each detector's run went.

    ``statuses`` has a row for each query, candidate of the manifest and detector, measured or not; ``job`` the run's
    tables and events. Without a readable query there are no tables.
    """

    partial: DataFrame | None
    final: DataFrame | None
    shortlist: DataFrame | None
    evidence: DataFrame | None
    absent: DataFrame | None
    statuses: DataFrame | None
    job: Job
    runs: dict[str, tuple[str, str | None]] = field(default_factory=dict)


#: What a hand-over gets: level (1 or 2), ``partial``, ``final`` or ``failed``, and the level's ranking.
OnResult = Callable[[int, str, DataFrame | None], None]


def word_confidence(words):
    """Mean probability of the words heard; 0 where none was."""
    total = F.aggregate(words, F.lit(0.0), lambda s, w: s + w["probability"].cast("double"))
    return F.when(F.size(words) > 0, total / F.size(words)).otherwise(F.lit(0.0))


def language_stable(windows, share: float = 0.80):
    """True where one language holds the share of the windows; no windows tell nothing."""
    most = F.array_max(F.transform(F.array_distinct(windows), lambda x: F.size(F.filter(windows, lambda y: y == x))))
    return F.coalesce((F.size(windows) > 0) & (most >= share * F.size(windows)), F.lit(False))


def gated(heard: DataFrame) -> DataFrame:
    tokens = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    return heard.select("clip_id", "text", "words", pr.gate(word_confidence(F.col("words")), language_stable(F.col("windows")), tokens).alias("decision"))


def transcribed(clips: DataFrame, hooks: Hooks) -> tuple[str, str | None, DataFrame | None]:
    """``(status, reason, clip_id, text, decision, used_separation)``: voices are separated only where the mix was not understood."""
    if hooks.transcribe is None:
        return "failed", "model_unavailable", None
    first = gated(hooks.transcribe(clips)).withColumn("used_separation", F.lit(False))
    if hooks.separate is None:
        return "ok", None, first
    again = clips.join(first.filter("decision <> 'pass'").select("clip_id"), "clip_id", "left_semi")
    second = gated(hooks.transcribe(hooks.separate(again))).withColumn("used_separation", F.lit(True))
    return "ok", None, first.filter("decision = 'pass'").unionByName(second)


def plain_transcript(clips: DataFrame, hooks: Hooks) -> DataFrame | None:
    """Texts without a gate."""
    return None if hooks.transcribe is None else hooks.transcribe(clips).select("clip_id", "text")


def matched_patterns(harmonic: DataFrame) -> DataFrame:
    """``query, candidate, pattern``: chord n-grams of the matched stretches, as degrees."""
    from ..functions.text import array_ngrams

    grams = F.flatten(F.array(*(array_ngrams(F.col("chords"), n) for n in CHORD_SIZES)))
    found = harmonic.filter("status = 'ok'").select("query", "candidate", F.explode(grams).alias("gram"))
    return found.select("query", "candidate", F.array_join(music.degrees(F.split("gram", "\x1f")), "\x1f").alias("pattern"))


def commonality_of(harmonic: DataFrame, frequencies: DataFrame, size: DataFrame) -> DataFrame:
    """``query, candidate, mean_idf, corpus_frequency``; NULL for an empty corpus."""
    known = commonality.with_idf(matched_patterns(harmonic), frequencies.select("pattern", "df"), size, ["pattern"])
    known = known.crossJoin(F.broadcast(size.select(F.col(size.columns[0]).alias("_n")).limit(1)))
    return known.groupBy("query", "candidate").agg(F.avg(F.when(F.col("_n") > 0, F.col("idf"))).alias("mean_idf"), F.max("df").alias("corpus_frequency"))


def level_one(spark: SparkSession, fingerprint: DataFrame | None, harmonic: DataFrame | None) -> DataFrame:
    """Every query with every candidate that either detector has a result for."""
    blank = lambda kinds: spark.createDataFrame([], kinds)
    f = blank("query string, candidate string, peak_ratio double, q_start double, q_end double, repetitions int, semitones double, tempo double") if fingerprint is None else fingerprint
    h = blank("query string, candidate string, status string, reason string, qmax double, coverage double, chords array<string>") if harmonic is None else harmonic
    f = f.select("query", "candidate", F.lit("ok").alias("fingerprint_status"), F.col("peak_ratio").alias("peak"), (F.col("q_end") - F.col("q_start")).alias("span_len"), F.col("repetitions").alias("reps"), "semitones", "tempo")
    h = h.select("query", "candidate", F.col("status").alias("harmonic_status"), F.col("reason").alias("harmonic_reason"), "qmax", "coverage", F.col("transposition") if "transposition" in h.columns else F.lit(None).cast("int").alias("transposition"))
    rows = f.join(h, ["query", "candidate"], "full")
    return rows.withColumn("has_transform", F.coalesce(matching.transform_struct(F.col("semitones"), F.col("tempo")).isNotNull(), F.lit(False)))


def measured(rows: DataFrame, lyrics: DataFrame | None, melodic: DataFrame | None, common: DataFrame) -> DataFrame:
    """The measurement table of the cascade."""
    out = rows.join(common, ["query", "candidate"], "left")
    out = out.withColumn("lyrics_status", F.lit(None).cast("string")).withColumn("jaccard", F.lit(None).cast("double")).withColumn("semantic", F.lit(None).cast("double")) if lyrics is None else out.join(
        lyrics.select("query", "candidate", F.col("status").alias("lyrics_status"), "jaccard", "semantic", F.col("spans").alias("text_spans")), ["query", "candidate"], "left")
    out = out.withColumn("run", F.lit(None).cast("int")) if melodic is None else out.join(melodic.select("query", "candidate", "run", F.col("spans").alias("melody_spans")), ["query", "candidate"], "left")
    return out.withColumnRenamed("candidate", "supplier")


def statuses(pairs: DataFrame, absent: DataFrame, runs: dict[str, tuple[str, str | None]], results: dict[str, tuple[DataFrame | None, str]]) -> DataFrame:
    """``query, candidate, detector, status, reason`` for every pair and detector.

    ``results`` maps a detector to its results (``query, candidate, status, reason``) and to what is said of pairs
    that it gave none. A run that did not happen outranks its results; a candidate without sound is the reason of
    whatever did not succeed for it, whichever detector noticed. Detectors without a run were not run.
    """
    lacking = absent.select("candidate", F.col("reason").alias("_absent"))
    rows = pairs.join(lacking, "candidate", "left")
    for name, (found, unsaid) in results.items():
        status, why = runs.get(name, ("not_applicable", "the detector was not run"))
        if status != "ok" or found is None:
            own = F.struct(F.lit(status).alias("status"), F.lit(why).alias("reason"))
        else:
            rows = rows.join(found.select("query", "candidate", F.struct("status", "reason").alias(f"_{name}")), ["query", "candidate"], "left")
            none = F.struct(F.when(F.col("_absent").isNotNull(), "failed").otherwise("not_applicable").alias("status"), F.lit(unsaid).alias("reason"))
            own = F.coalesce(F.col(f"_{name}"), none)
        reason = F.when((own["status"] != "ok") & F.col("_absent").isNotNull(), F.col("_absent")).otherwise(own["reason"])
        rows = rows.withColumn(f"_{name}", F.struct(F.lit(name).alias("detector"), own["status"].alias("status"), reason.alias("reason")))
    return rows.select("query", "candidate", F.explode(F.array(*(F.col(f"_{n}") for n in results))).alias("d")).select("query", "candidate", "d.*")


def leaders(ranking: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The first of each query's ranking: ``query, candidate, verdict_class, probability``; ``NONE`` without a score."""
    best = ranking.filter("rank = 1").select("query", "candidate")
    rows = verdicts.select("query", F.col("supplier").alias("candidate"), "verdict_class", "probability", "probability_status")
    return best.join(rows, ["query", "candidate"], "left")


def analyze(
    spark: SparkSession, queries: DataFrame, candidate_clips: DataFrame, candidates: DataFrame, frequencies: DataFrame | None = None, corpus_size: int = 0,
    hooks: Hooks | None = None, texts: DataFrame | None = None, alignment: kernels.Alignment = kernels.DEFAULT, folder: str | None = None,
    on_result: OnResult | None = None, listener: Callable[[dict], None] | None = None, models: dict[str, calibration.Model] | None = None,
    phrases: tuple[DataFrame, int] | None = None, shingles: tuple[DataFrame, int] | None = None, index: HashIndex | None = None,
) -> Analysis:
    """The run over ``queries`` and ``candidate_clips`` (tables of clips) and ``candidates`` (the manifest, keyed by ``candidate``).

    ``frequencies`` (``pattern, df``) and ``corpus_size`` are the corpus of chords, ``phrases`` and ``shingles``
    those of intervals and words (table and size); ``index`` has the candidates' fingerprints; ``texts`` are the candidates' lyrics (``clip_id, text,
    instrumental``); ``models`` are calibrated scores by class. A query that could not be read has no ranking; if
    none could, the run fails, which is an event and a result like any other.

    ``on_result`` gets each level's ranking when it is stored and before its verdict is announced; level 2 begins
    after that. Every stage's result and event is stored in ``folder``: a run that is started again on it reads
    what is there, calls no model for it and says nothing twice; a hand-over that was not followed by its verdict
    is repeated. Events also go to ``listener``, as they are stored.
    """
    hooks, runs, job, hand = hooks or Hooks(), {}, Job(spark, folder, listener), on_result or (lambda *_: None)
    readable = queries.filter("status = 'ok'")
    job.emit("ingest", 1, "running")
    if readable.isEmpty():
        job.emit("ingest", 1, "failed", reason="no query could be read")
        if job.outcome("verdict", 1) is None:
            hand(1, "failed", None)
        job.emit("verdict", 1, "failed", **{"class": "NONE"})
        return Analysis(None, None, None, None, None, None, job, {"ingest": ("failed", "no query could be read")})
    heard = candidate_clips.filter("status = 'ok'")
    manifest = candidates.join(candidate_clips.select(F.col("clip_id").alias("candidate"), F.col("status").alias("clip_status")), "candidate", "left").withColumn("clip_status", F.coalesce("clip_status", F.lit(AUDIO_MISSING)))
    absent = job.store("absent", lambda: manifest.filter("clip_status <> 'ok'").select("candidate", F.lit(AUDIO_MISSING).alias("reason")))
    job.emit("ingest", 1, "done", queries=readable.count(), candidates=candidates.count(), audio_missing=absent.count())

    def stage(name: str, level: int, work: Callable[[], tuple[str, str | None, DataFrame | None]]) -> DataFrame | None:
        """A detector's results, stored once; how it ended is an event, and stands if the run is started again."""
        before = job.outcome(name, level)
        if before is None or (before["status"] == "done" and not job.has(name)):
            job.emit(name, level, "running")

            def made() -> DataFrame:
                status, reason, found = work()
                if found is None:
                    raise engine.Unavailable(status, reason)
                return found

            status, reason = "ok", None
            try:
                job.store(name, made)
            except engine.Unavailable as error:
                status, reason = error.status, error.reason
            except Exception as error:  # noqa: BLE001  an error of its tasks is the detector's failure
                status, reason = "failed", engine.named(error)
            job.emit(name, level, STAGE.get(status, "failed"), outcome=status, reason=reason)
            before = job.outcome(name, level)
        runs[name] = (before["detail"]["outcome"], before["detail"]["reason"])
        return job.table(name) if runs[name][0] == "ok" else None

    def guarded(name: str, q: Callable[[], DataFrame], c: Callable[[], DataFrame], context: dict):
        return lambda: engine.run_guarded(spark, engine.get(name), q(), c(), context)

    # level 1
    harmonic = stage("harmonic", 1, guarded("harmonic", lambda: readable, lambda: heard, {"alignment": alignment}))
    # one run has the plain pass and, for those that the harmony suggests, the grid
    given = {"index": index} | ({"harmonic": harmonic.filter("status = 'ok'")} if harmonic is not None else {})
    fingerprint = stage("fingerprint", 1, guarded("fingerprint", lambda: readable, lambda: heard, given))
    size = spark.createDataFrame([(corpus_size,)], "n long")
    frequencies = spark.createDataFrame([], "pattern string, df long") if frequencies is None else frequencies
    common = job.store("commonality", lambda: commonality_of(harmonic, frequencies, size) if harmonic is not None else spark.createDataFrame([], "query string, candidate string, mean_idf double, corpus_frequency long"))
    order = [F.desc_nulls_last("qmax"), F.desc_nulls_last("peak"), F.col("candidate")]
    short = job.store("shortlist", lambda: engine.shortlisted(level_one(spark, fingerprint, harmonic), "query", "harmonic_status", "fingerprint_status", order, keep_hits=True))
    job.emit("shortlist", 1, "done", entries=short.count(), corpus=corpus_size)
    dated = manifest.select("candidate", "published")

    def concluded(level: int, lyrics: DataFrame | None, melodic: DataFrame | None, status: str, **more) -> tuple[DataFrame, DataFrame]:
        """The level's verdicts and ranking, stored, handed out, announced, in this order."""
        rows = job.store(f"verdicts-{level}", lambda: calibration.calibrated(fusion.verdicts(measured(short, lyrics, melodic, common), corpus_size), models or {}))
        ranked = job.store(f"ranking-{level}", lambda: engine.ranking(rows, dated))
        first = job.store(f"leaders-{level}", lambda: leaders(ranked, rows))
        if job.outcome("verdict", level) is None:
            hand(level, status, ranked)
        classes = {r["verdict_class"] or "NONE": r["count"] for r in first.groupBy("verdict_class").count().collect()}  # eight classes
        job.emit("verdict", level, status, classes=classes, **more)
        return rows, ranked

    rows1, partial = concluded(1, None, None, "partial")

    # level 2
    chosen = short.select("query", "candidate")
    spoken = stage("transcript", 2, lambda: transcribed(readable, hooks))
    lyrics = None
    if job.has("lyrics") or (spoken is not None and texts is not None):
        lyrics = stage("lyrics", 2, lambda: lyrics_of(spark, spoken, texts, chosen, hooks, shingles))
    if (sung := hooks.sung()) is None:
        melodic = stage("melodic", 2, lambda: ("failed", "model_unavailable", None))
    else:
        melodic = stage("melodic", 2, guarded("melodic", lambda: sung(readable), lambda: sung(heard.join(chosen.select(F.col("candidate").alias("clip_id")).distinct(), "clip_id", "left_semi")), {"pairs": chosen, "phrases": phrases}))
    before = job.table("leaders-1").select("query", F.col("verdict_class").alias("before"))
    rows2, final = concluded(2, lyrics, melodic, "final")
    changed = job.store("upgrades", lambda: job.table("leaders-2").join(before, "query", "left").select("query", "candidate", F.coalesce("before", F.lit("NONE")).alias("previous_class"), "verdict_class", "probability", "probability_status"))
    job.emit("upgrade", 2, "done", changed=changed.filter("previous_class <> verdict_class").count())

    evidence = rows2.join(manifest.select(F.col("candidate").alias("supplier"), "artist", "title", "license"), "supplier", "left")
    legal = fusion.assess(F.col("verdict_class"), F.col("license"), F.col("artist"), F.col("title"), F.col("semitones"), F.col("tempo"), F.col("peak"))
    evidence = evidence.withColumn("legal", legal).withColumn("explanation", fusion.explanation(F.col("verdict_class"))).withColumnRenamed("supplier", "candidate")
    # the queries are a stated set; every candidate of the manifest has a row of each detector for each of them
    everyone = manifest.select("candidate").crossJoin(F.broadcast(readable.select(F.col("clip_id").alias("query"))))
    matched = None if fingerprint is None else fingerprint.select("query", "candidate", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("reason"))
    told = statuses(everyone, absent, runs, {
        "fingerprint": (matched, "no alignment above the noise"), "harmonic": (harmonic, "filtered out by the global descriptor before the matrix was computed"),
        "lyrics": (lyrics, "not on the shortlist"), "melodic": (melodic, "not on the shortlist")})
    return Analysis(partial, final, chosen, evidence, absent, told, job, runs)


def lyrics_of(spark, spoken, texts, pairs, hooks, shingles) -> tuple[str, str | None, DataFrame | None]:
    """Lyrics of the queries whose transcript passed the gate; the others' results are ``gated``. Candidates without a text do not apply."""
    said = spoken.filter("decision = 'pass'").select("clip_id", "text", F.lit(False).alias("instrumental"))
    status, reason, found = engine.run_guarded(spark, engine.get("lyrics"), said, texts, {"pairs": pairs, "embed": hooks.embed, "shingles": shingles})
    if found is None:
        return status, reason, None
    stopped = spoken.filter("decision <> 'pass'").select(F.col("clip_id").alias("query"), "decision")
    skipped = pairs.join(stopped, "query").select("query", "candidate", F.lit("gated").alias("status"), F.col("decision").alias("reason"))
    silent = pairs.join(said.select(F.col("clip_id").alias("query")), "query", "left_semi").join(texts.select(F.col("clip_id").alias("candidate")), "candidate", "left_anti")
    silent = silent.select("query", "candidate", F.lit("not_applicable").alias("status"), F.lit("no_lyrics").alias("reason"))
    return "ok", None, found.unionByName(skipped.unionByName(silent), allowMissingColumns=True)


__all__ = ["Analysis", "Hooks", "analyze", "detectors", "statuses"]
