"""The engine: detectors by name, and measurements composed into a ranking with rights."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import fusion
from ..storage import materialised

#: Longest shortlist that is ranked or measured expensively.
SHORTLIST = 20
#: Rows that a task gets, about, where the rows of a query are brought together.
ROWS_A_TASK = 1 << 18


def dealt(rows: DataFrame, query: str, most: int = ROWS_A_TASK) -> DataFrame:
    """The rows dealt out by query, before anything is sorted or aggregated, to as many tasks as they ask for.

    What a task sorts or aggregates afterwards stays as small on a large table as on a small one; a query has few rows.
    """
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-rows.count() // most)), query)


class Detector(Protocol):
    """One detector: measurements of the candidates for the queries, ``query, candidate, status, reason`` and its own columns."""

    name: str
    level: int

    def run(self, spark: SparkSession, queries: DataFrame, candidates: DataFrame, context: dict) -> DataFrame: ...


_DETECTORS: dict[str, Detector] = {}


def register(detector: Detector) -> Detector:
    _DETECTORS[detector.name] = detector
    return detector


def get(name: str) -> Detector:
    return _DETECTORS[name]


class Unavailable(Exception):
    """A detector that gave no results: status and reason."""

    def __init__(self, status: str, reason: str | None):
        super().__init__(reason)
        self.status, self.reason = status, reason


def named(error: Exception) -> str:
    return f"{type(error).__name__}: {str(error)[:200]}"


def run_guarded(spark: SparkSession, detector: Detector, queries: DataFrame, candidates: DataFrame, context: dict, store: bool = False) -> tuple[str, str | None, DataFrame | None]:
    """``(status, reason, results)``: an error is a failed run, and a failed run has no results.

    Planning errors always are; with ``store`` the results are also computed here, once, into the shared folder, so
    that errors of tasks are caught too and plans built on the results do not repeat the detector.
    """
    try:
        found = detector.run(spark, queries, candidates, context)
        return "ok", None, materialised(found, detector.name) if store else found
    except Exception as error:  # noqa: BLE001  any failure of a detector becomes its status
        return "failed", named(error), None


def with_results(candidates: DataFrame, results: DataFrame | None, key: str) -> DataFrame:
    """Every candidate with its results; those without any are ``not_applicable``."""
    if results is None:
        return candidates.withColumn("status", F.lit("not_applicable"))
    joined = candidates.join(results, key, "left")
    return joined.withColumn("status", F.coalesce("status", F.lit("not_applicable")))


def shortlisted(entries: DataFrame, query: str, harmonic: str, fingerprint: str, order: list, k: int = SHORTLIST, keep_hits: bool = False) -> DataFrame:
    """Who is measured further: the harmonic results that are ok, else the fingerprint's, else everybody; k at most.

    ``keep_hits`` also keeps fingerprint hits that the harmonic rank would drop.
    """
    w = Window.partitionBy(query)
    any_h, any_f = F.max((F.col(harmonic) == "ok").cast("int")).over(w), F.max((F.col(fingerprint) == "ok").cast("int")).over(w)
    eligible = F.when(any_h == 1, F.col(harmonic) == "ok").when(any_f == 1, F.col(fingerprint) == "ok").otherwise(F.lit(True))
    out = entries.withColumn("_e", F.coalesce(eligible, F.lit(False)))
    ranked = out.withColumn("_r", F.row_number().over(w.orderBy(F.desc("_e"), *order)))
    hit = F.coalesce(F.col(fingerprint) == "ok", F.lit(False)) if keep_hits else F.lit(False)
    return ranked.filter((F.col("_e") & (F.col("_r") <= k)) | hit).drop("_e", "_r")


def ranking(verdicts: DataFrame, candidates: DataFrame, k: int = SHORTLIST) -> DataFrame:
    """The shortlist of each query (its k best by probability), ranked with chronology deciding near ties."""
    best = dealt(verdicts, "query").groupBy("query", F.col("supplier").alias("candidate")).agg(F.max(F.struct(F.coalesce("probability", F.lit(-1.0)).alias("p"), "verdict_class")).alias("b"))
    best = best.select("query", "candidate", F.when(F.col("b.p") >= 0, F.col("b.p")).alias("probability"), F.col("b.verdict_class").alias("verdict_class"))
    w = Window.partitionBy("query").orderBy(F.desc_nulls_last("probability"), "candidate")
    short = best.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r").join(candidates.select("candidate", "published"), "candidate", "left")
    return fusion.rank_candidates(short, "query", "candidate", "verdict_class", "probability", "published")


def analyze(measurements: DataFrame, candidates: DataFrame, corpus_size: int) -> DataFrame:
    """Measurements with class, layer, probability and legal block: one pass of expressions and one join."""
    v = fusion.verdicts(measurements, corpus_size)
    joined = v.join(candidates.select("candidate", "artist", "title", "license"), F.col("supplier") == F.col("candidate"))
    legal = fusion.assess(F.col("verdict_class"), F.col("license"), F.col("artist"), F.col("title"), F.col("semitones"), F.col("tempo"), F.col("peak"))
    return joined.withColumn("legal", legal).withColumn("explanation", fusion.explanation(F.col("verdict_class")))


def summary(analyzed: DataFrame) -> DataFrame:
    flagged = F.count_if(F.array_contains("legal.flags", "recognizable_excerpt"))
    return analyzed.groupBy("verdict_class", "layer", "license").agg(F.count("*").alias("n"), F.round(F.avg("probability"), 6).alias("probability"), flagged.alias("flagged"))


#: Row-wise manifest rules: text and predicate.
RULES: list[tuple[str, Callable[[], object]]] = [
    ("R4 date without source", lambda: F.col("published").isNotNull() & F.col("published_source").isNull()),
    ("R5 source without date", lambda: F.col("published").isNull() & F.col("published_source").isNotNull()),
    ("R6 date is not ISO", lambda: F.col("published").isNotNull() & F.expr("try_to_date(published, 'yyyy-MM-dd')").isNull()),
    ("R7 audio_path outside data/audio/", lambda: ~F.col("audio_path").startswith("data/audio/")),
    ("R8 instrumental with lyrics", lambda: F.col("instrumental") & F.col("lyrics_path").isNotNull()),
]


def manifest_violations(candidates: DataFrame) -> DataFrame:
    """``candidate, violation`` for every broken rule; row rules in one pass, uniqueness by aggregation."""
    rows = F.array_compact(F.array(*(F.when(rule(), F.lit(text)) for text, rule in RULES)))
    broken = candidates.select("candidate", F.explode(rows).alias("violation"))
    for text, column in (("R2 id is not unique", "candidate"), ("R3 audio_path is not unique", "audio_path")):
        twice = candidates.groupBy(column).agg(F.count("*").alias("_n")).filter("_n > 1").select(column)
        broken = broken.unionAll(candidates.join(twice, column, "left_semi").select("candidate", F.lit(text).alias("violation")))
    return broken
