"""Scalar functions and the decision cascade, with every pattern of missing measurements."""

import itertools

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tracefold.functions import music, predicates, rights, text
from tracefold.operators import fusion
from tracefold.thresholds import REGISTRY, threshold


def one(spark, column, **values):
    schema = ", ".join(f"{n} {t}" for n, (t, _) in values.items()) or "x int"
    df = spark.createDataFrame([tuple(v for _, v in values.values()) or (1,)], schema)
    return df.select(column.alias("r")).first()["r"]


def test_missing_is_not_zero(spark):
    for name, want in (("above", False), ("below", False), ("at_least", False), ("absent_or_below", True)):
        assert one(spark, getattr(predicates, name)(F.col("x"), 0.4), x=("double", None)) is want


def test_threshold_names_are_checked():
    assert threshold("VERSION_QMAX") == 0.25 and len(REGISTRY) == 20
    with pytest.raises(KeyError):
        threshold("NO_SUCH")


COLUMNS = "peak double, span_len double, reps int, has_transform boolean, qmax double, coverage double, lyrics_status string, jaccard double, semantic double, run int"
EMPTY = dict(peak=None, span_len=None, reps=None, has_transform=None, qmax=None, coverage=None, lyrics_status=None, jaccard=None, semantic=None, run=None)


def decided(spark, **m):
    return spark.createDataFrame([Row(**(EMPTY | m))], COLUMNS).select(fusion.decide().alias("c")).first()["c"]


@pytest.mark.parametrize(("measured", "want"), [
    (dict(peak=0.9, span_len=40.0), "EXACT"),
    (dict(peak=0.9, span_len=15.0), "NONE"),
    (dict(peak=0.9, span_len=40.0, has_transform=True, qmax=0.6), "MODIFIED"),
    (dict(peak=0.5, span_len=6.0, reps=2), "EXCERPT_PHONOGRAM"),
    (dict(peak=0.5, span_len=6.0, reps=1), "NONE"),
    (dict(qmax=0.3, coverage=0.6), "VERSION"),
    (dict(peak=0.45, qmax=0.3, coverage=0.6), "NONE"),
    (dict(qmax=0.3, coverage=0.6, lyrics_status="ok", semantic=0.5), "NONE"),
    (dict(qmax=0.3, coverage=0.6, lyrics_status="failed"), "VERSION"),
    (dict(run=8, coverage=0.3), "EXCERPT_WORK"),
    (dict(qmax=0.1, lyrics_status="ok", jaccard=0.6), "LYRICS"),
    (dict(), "NONE"),
])
def test_rules(spark, measured, want):
    assert decided(spark, **measured) == want


def test_no_measurement_decides_by_being_absent_except_the_fingerprint(spark):
    base = dict(peak=0.1, qmax=0.3, coverage=0.6)
    rows = [Row(**(EMPTY | {k: (None if drop else v) for (k, v), drop in zip(base.items(), mask, strict=True)})) for mask in itertools.product((0, 1), repeat=3)]
    got = [r["c"] for r in spark.createDataFrame(rows, COLUMNS).select(fusion.decide().alias("c")).collect()]
    assert got == ["VERSION", "NONE", "NONE", "NONE", "VERSION", "NONE", "NONE", "NONE"]


@pytest.mark.parametrize(("cls", "idf", "size", "want"), [("VERSION", 1.0, 100, "COMMON"), ("LYRICS", 1.0, 100, "COMMON"), ("EXACT", 1.0, 100, "EXACT"), ("VERSION", None, 100, "VERSION"), ("VERSION", 0.0, 0, "VERSION"), ("VERSION", 5.0, 100, "VERSION")])
def test_degradation(spark, cls, idf, size, want):
    assert one(spark, fusion.degraded(F.lit(cls), F.col("i"), F.lit(size)), i=("double", idf)) == want


def test_ranking_puts_the_older_of_near_equals_first_and_none_last(spark):
    rows = [(1, "a", "EXACT", 0.90, "1990-01-01"), (1, "b", "EXACT", 0.91, "1995-01-01"), (1, "c", "NONE", 0.99, None), (1, "d", "VERSION", None, None), (1, "e", "VERSION", 0.5, "1980")]
    df = spark.createDataFrame(rows, "query long, candidate string, cls string, score double, published string")
    got = fusion.rank_candidates(df, "query", "candidate", "cls", "score", "published").orderBy("rank").collect()
    assert [r["candidate"] for r in got] == ["a", "b", "e", "c", "d"]


@pytest.mark.parametrize(("chords", "want"), [(["C", "G", "Am", "F"], ["0", "7", "9m", "5"]), (["G", "Am", "F", "C"], ["0", "2m", "10", "5"]), (["Cm", "Fm", "Gm"], ["0m", "5m", "7m"]), (["C", "N", "G"], ["C", "N", "G"])])
def test_degrees(spark, chords, want):
    assert one(spark, music.degrees(F.col("c")), c=("array<string>", chords)) == want


def test_licences(spark):
    assert one(spark, rights.attribution(F.lit("Band"), F.lit("Track"), F.lit("cc-by-nc-sa-3.0"))) == 'Band, "Track", CC BY-NC-SA 3.0'
    assert one(spark, rights.licence_name(F.lit("public_domain"))) == "public domain"


def test_pastiche(spark):
    m = rights.modification(F.lit(5.0), F.lit(1.3))
    block = one(spark, fusion.assess(F.lit("EXCERPT_PHONOGRAM"), F.lit("all_rights_reserved"), F.lit("a"), F.lit("t"), F.lit(5.0), F.lit(1.3), F.lit(0.7)))
    assert one(spark, m) > 0.3 and "possible_pastiche" in block["flags"] and "recognizable_excerpt" in block["flags"]
    open_ = one(spark, fusion.assess(F.lit("EXCERPT_PHONOGRAM"), F.lit("cc-by-4.0"), F.lit("a"), F.lit("t"), F.lit(5.0), F.lit(1.3), F.lit(0.7)))
    assert open_["flags"] == []


@pytest.mark.parametrize(("header", "want"), [("bytes=0-99", (0, 99)), ("bytes=990-2000", (990, 999)), ("bytes=-10", (990, 999)), ("bytes=10-", (10, 999)), ("junk", (0, 999)), ("bytes=2000-", None), ("bytes=-", (0, 999)), (None, (0, 999))])
def test_byte_ranges(spark, header, want):
    got = one(spark, rights.byte_range(F.col("h"), F.lit(1000).cast("long")), h=("string", header))
    assert (got and tuple(got)) == want


@pytest.mark.parametrize(("message", "want"), [("HTTP Error 429: Too Many Requests", "throttled"), ("HTTP Error 404", "unavailable"), ("HTTP Error 502", "network"), ("not available in your country", "geoblocked"), ("Private video", "unavailable"), ("timed out", "network"), ("odd", "unknown")])
def test_error_reasons(spark, message, want):
    assert one(spark, predicates.error_reason(F.lit(message))) == want


def test_tokens(spark):
    assert one(spark, text.tokens(F.lit("Don't don't  STOP -- stop, now! now"))) == ["dont", "stop", "now"]
    assert one(spark, text.words(F.lit(""))) == [] and one(spark, text.array_ngrams(F.array(F.lit("a"), F.lit("b")), 3)) == []
    assert one(spark, text.array_ngrams(F.array(*map(F.lit, "abcd")), 3, " ")) == ["a b c", "b c d"]


def test_gate_order(spark):
    assert one(spark, predicates.gate(F.lit(0.2), F.lit(False), F.lit(0))) == "asr_confidence"
    assert one(spark, predicates.gate(F.lit(0.9), F.lit(False), F.lit(5))) == "language_unstable"
    assert one(spark, predicates.gate(F.lit(0.9), F.lit(True), F.lit(0))) == "no_speech"
    assert one(spark, predicates.gate(F.lit(0.9), F.lit(True), F.lit(5))) == "pass"
