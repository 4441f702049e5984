"""From measurements to one evidence class: the cascade, degradation, probability, rights, ranking."""

from __future__ import annotations

from functools import cmp_to_key

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rights
from ..functions.predicates import above, absent_or_below, at_least, below, open_licence
from ..thresholds import LEGAL_MODIFIED, LEGAL_PASTICHE_RECOGNISABLE, LEGAL_RECOGNISABLE, RANK_TIE, threshold
from .commonality import common_threshold, should_degrade

CLASSES = ("EXACT", "MODIFIED", "VERSION", "EXCERPT_PHONOGRAM", "EXCERPT_WORK", "LYRICS", "COMMON", "NONE")
PHONOGRAM = ("EXACT", "MODIFIED", "EXCERPT_PHONOGRAM")
WORK = ("VERSION", "EXCERPT_WORK", "LYRICS")
DISCLAIMER = "Technical similarity only; not legal advice."


def decide(overrides: dict[str, float] | None = None, monotone: bool = False) -> Column:
    """The class before degradation, over the columns of the measurement table; the first rule that holds wins.

    ``monotone`` keeps a version verdict that the lyrics, measured later, do not support.
    """
    t = {n: threshold(n, overrides) for n in (
        "EXACT_PEAK_RATIO", "EXACT_MIN_SPAN_S", "MODIFIED_PEAK_RATIO", "MODIFIED_QMAX", "EXCERPT_PEAK_RATIO", "EXCERPT_MIN_REPETITIONS", "VERSION_MAX_PEAK_RATIO",
        "VERSION_QMAX", "VERSION_COVERAGE", "VERSION_SEMANTIC_SIM", "EXCERPT_WORK_MIN_RUN", "EXCERPT_WORK_MAX_COVERAGE", "LYRICS_MAX_QMAX", "LYRICS_JACCARD")}
    peak, span, qmax, coverage = (F.col(c) for c in ("peak", "span_len", "qmax", "coverage"))
    transformed = F.coalesce(F.col("has_transform"), F.lit(False))
    lyrics = F.coalesce(F.col("lyrics_status") == "ok", F.lit(False))
    reps, run = F.coalesce("reps", F.lit(0)), F.coalesce("run", F.lit(0))
    words_agree = above(F.col("semantic"), t["VERSION_SEMANTIC_SIM"]) | ~lyrics
    if monotone:
        words_agree = F.lit(True)
    return (
        F.when(~transformed & above(peak, t["EXACT_PEAK_RATIO"]) & above(span, t["EXACT_MIN_SPAN_S"]), "EXACT")
        .when(transformed & above(peak, t["MODIFIED_PEAK_RATIO"]) & above(qmax, t["MODIFIED_QMAX"]), "MODIFIED")
        .when(above(peak, t["EXCERPT_PEAK_RATIO"]) & below(span, t["EXACT_MIN_SPAN_S"]) & (reps >= t["EXCERPT_MIN_REPETITIONS"]), "EXCERPT_PHONOGRAM")
        .when(absent_or_below(peak, t["VERSION_MAX_PEAK_RATIO"]) & above(qmax, t["VERSION_QMAX"]) & above(coverage, t["VERSION_COVERAGE"]) & words_agree, "VERSION")
        .when((run >= t["EXCERPT_WORK_MIN_RUN"]) & below(coverage, t["EXCERPT_WORK_MAX_COVERAGE"]), "EXCERPT_WORK")
        .when(below(qmax, t["LYRICS_MAX_QMAX"]) & lyrics & above(F.col("jaccard"), t["LYRICS_JACCARD"]), "LYRICS")
        .otherwise("NONE"))


def degraded(cls: Column, mean_idf: Column, size: Column, limit: float | None = None) -> Column:
    return F.when(should_degrade(cls, mean_idf, size, common_threshold() if limit is None else limit), "COMMON").otherwise(cls)


def layer(cls: Column) -> Column:
    return F.when(cls.isin(*PHONOGRAM), "phonogram").when(cls.isin(*WORK), "work")


def raw_probability(cls: Column) -> Column:
    peak, qmax, run = F.col("peak"), F.col("qmax"), F.coalesce("run", F.lit(0)).cast("double")
    return (F.when(cls.isin(*PHONOGRAM), peak).when(cls.isin("VERSION", "COMMON"), qmax).when(cls == "LYRICS", F.col("jaccard"))
            .when(cls == "EXCERPT_WORK", run / F.greatest(run, F.lit(8.0))).otherwise(F.greatest(peak, qmax)))


def explanation(cls: Column) -> Column:
    """Sentences with two decimals; a missing measurement is named, never shown as 0."""
    def said(label, x):
        return F.concat(F.lit(f"{label} "), F.when(x.isNull(), "no measurement").otherwise(F.format_string("%.2f", F.bround(x, 2))))
    return F.array_join(F.array(F.concat(F.lit("Class "), cls), said("peak ratio", F.col("peak")), said("qmax", F.col("qmax")), said("coverage", F.col("coverage"))), ". ")


def verdicts(measurements: DataFrame, corpus_size: int, **options) -> DataFrame:
    """Measurements with ``rule_class``, ``verdict_class``, ``layer`` and ``probability``."""
    out = measurements.withColumn("rule_class", decide(**options))
    out = out.withColumn("verdict_class", degraded(F.col("rule_class"), F.col("mean_idf"), F.lit(corpus_size)))
    return out.withColumn("layer", layer(F.col("verdict_class"))).withColumn("probability", raw_probability(F.col("verdict_class")))


def risk_flags(cls: Column, licence: Column, modification: Column, recognisability: Column) -> Column:
    concerned = ~open_licence(licence) & cls.isin(*rights.EXCERPTS)
    known = F.when(concerned & at_least(recognisability, LEGAL_RECOGNISABLE), "recognizable_excerpt")
    pastiche = F.when(concerned & at_least(modification, LEGAL_MODIFIED) & at_least(recognisability, LEGAL_PASTICHE_RECOGNISABLE), "possible_pastiche")
    return F.array_compact(F.array(known, pastiche))


def assess(cls: Column, licence: Column, artist: Column, title: Column, semitones: Column, tempo: Column, peak: Column) -> Column:
    """The legal block; scores only for excerpts, the disclaimer always."""
    excerpt = cls.isin(*rights.EXCERPTS)
    modified, known = F.when(excerpt, rights.modification(semitones, tempo)), F.when(excerpt, rights.recognisability(peak))
    return F.struct(rights.layers(cls).alias("rights_layers"), modified.alias("modification"), known.alias("recognizability"), risk_flags(cls, licence, modified, known).alias("flags"),
                    F.when(open_licence(licence), rights.attribution(artist, title, licence)).alias("attribution"), F.lit(DISCLAIMER).alias("disclaimer"))


def alignment_block(query_span: Column, candidate_span: Column, transposition: Column, tempo: Column) -> Column:
    """All four parts, or NULL where none was measured."""
    parts = F.struct(query_span.alias("query_span"), candidate_span.alias("candidate_span"), transposition.alias("transposition"), tempo.alias("tempo_ratio"))
    return F.when(F.coalesce(query_span.cast("string"), candidate_span.cast("string"), transposition.cast("string"), tempo.cast("string")).isNotNull(), parts)


def evidence_status(run_status: Column, status: Column) -> Column:
    """The run's status outranks the result's; without a result nothing applied."""
    return F.when(run_status.isNotNull() & (run_status != "ok"), run_status).otherwise(F.coalesce(status, F.lit("not_applicable")))


def _before(a: tuple, b: tuple) -> int:
    """Better score first; scores within the tie go by publication date, where both are known."""
    (sa, da), (sb, db) = a[:2], b[:2]
    if sa is None or sb is None:
        return (sa is None) - (sb is None)
    if abs(sa - sb) <= RANK_TIE + 1e-12 and da and db and da != db:
        return -1 if da < db else 1
    return (sa < sb) - (sa > sb)


def rank_candidates(entries: DataFrame, query: str, candidate: str, cls: str, score: str, published: str) -> DataFrame:
    """``query, candidate, rank``: by score with chronology deciding near ties; NONE and unscored entries last.

    The comparison is not transitive, so its result depends on the sort: each query's entries, a shortlist of
    bounded length, are sorted in one call of a stable sort, from the order of their ids.
    """
    from .pairs import map_rows

    kinds = dict(entries.dtypes)
    live = F.when(F.col(cls) != "NONE", F.col(score))
    rows = entries.groupBy(query).agg(F.collect_list(F.struct(F.col(candidate).alias("c"), live.cast("double").alias("s"), F.col(published).alias("d"))).alias("e"))

    def ranked(r):
        order = sorted(sorted(r["e"], key=lambda x: x["c"]), key=cmp_to_key(lambda x, y: _before((x["s"], x["d"]), (y["s"], y["d"]))))
        return [(r[query], x["c"], k) for k, x in enumerate(order, 1)]

    return map_rows(rows, [query, "e"], f"{query} {kinds[query]}, {candidate} {kinds[candidate]}, rank long", ranked)
