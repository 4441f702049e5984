"""Predicates over measurements. NULL is "not measured" and never passes, with one named exception."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN_PREFIXES = ("cc", "public_domain")


def _known(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def above(x: Column, t: float) -> Column:
    return _known(x > F.lit(t))


def below(x: Column, t: float) -> Column:
    return _known(x < F.lit(t))


def at_least(x: Column, t: float) -> Column:
    return _known(x >= F.lit(t))


def absent_or_below(x: Column, t: float) -> Column:
    """The exception: passes where nothing was measured."""
    return x.isNull() | (x < F.lit(t))


def readable(run_status: Column, status: Column, x: Column) -> Column:
    """A measurement, only where the run and the result are both ``ok``."""
    return F.when((run_status == "ok") & (status == "ok"), x)


def carries_claim(status: Column, *measurements: Column) -> Column:
    """True where a result that is not ``ok`` holds a measurement."""
    held = F.lit(False)
    for m in measurements:
        held = held | m.isNotNull()
    return _known(status != "ok") & held


def open_licence(licence: Column) -> Column:
    return _known(licence.startswith(OPEN_PREFIXES[0]) | licence.startswith(OPEN_PREFIXES[1]))


def grid_eligible(qmax: Column, peak: Column) -> Column:
    """Worth trying transformed: harmonically close, while the plain fingerprint is silent."""
    return at_least(qmax, 0.25) & ~at_least(peak, 0.50)


def distinguishable_title(title: Column, min_words: int = 3, min_chars: int = 17) -> Column:
    """Long enough to name a work; with more words asked for, length alone no longer suffices."""
    words = F.size(F.split(F.trim(title), r"\s+")) >= min_words
    return _known(words if min_words > 3 else words | (F.length(title) >= min_chars))


def gate(confidence: Column, language_stable: Column, n_tokens: Column) -> Column:
    """First reason not to trust a transcript, or ``pass``."""
    return (F.when(confidence < 0.60, "asr_confidence").when(~language_stable, "language_unstable").when(n_tokens == 0, "no_speech").otherwise("pass"))


#: Reasons with their patterns, the first that matches wins (fixed values).
REASONS = (
    ("geoblocked", r"not available in your country|geo.?restrict|blocked it in your country"),
    ("throttled", r"http error 429|too many requests|rate.?limit|sign in to confirm"),
    ("unavailable", r"video unavailable|private video|removed|http error 404|http error 410|does not exist"),
    ("network", r"timed? ?out|connection|temporary failure|http error 5\d\d|unreachable"),
)


def error_reason(message: Column) -> Column:
    """Category of an error message: an HTTP code outranks the text, then the first pattern wins."""
    text = F.lower(message)
    code = F.regexp_extract(text, r"http error (\d{3})", 1)
    out = F.when(code == "429", "throttled").when(code.isin("404", "410"), "unavailable").when(code.startswith("5"), "network")
    for reason, pattern in REASONS:
        out = out.when(text.rlike(pattern), reason)
    return out.otherwise("unknown")
