"""Registry of decision thresholds. The values are fixed: results depend on them."""

from __future__ import annotations

from types import MappingProxyType

#: name -> (value, source: "cal" calibrated, "man" set by hand). Fixed values.
_VALUES = {
    "EXACT_PEAK_RATIO": (0.60, "cal"),
    "EXACT_MIN_SPAN_S": (15.0, "man"),
    "MODIFIED_PEAK_RATIO": (0.50, "cal"),
    "EXCERPT_PEAK_RATIO": (0.40, "cal"),
    "EXCERPT_MIN_REPETITIONS": (2.0, "man"),
    "VERSION_MAX_PEAK_RATIO": (0.40, "cal"),
    "VERSION_QMAX": (0.25, "cal"),
    "VERSION_COVERAGE": (0.50, "cal"),
    "EXCERPT_WORK_MIN_RUN": (8.0, "man"),
    "LYRICS_MAX_QMAX": (0.40, "man"),
    "LYRICS_JACCARD": (0.50, "man"),
    "COMMON_IDF_PERCENTILE": (0.01, "cal"),
    "FINGERPRINT_NOISE_FLOOR": (0.25, "man"),
    "FINGERPRINT_BIN_S": (0.1, "man"),
    "FINGERPRINT_ALIGN_TOLERANCE_S": (0.5, "man"),
    "FINGERPRINT_MIN_HASHES": (10.0, "man"),
    "FINGERPRINT_REPEAT_SHARE": (0.5, "man"),
    "MODIFIED_QMAX": (0.50, "man"),
    "VERSION_SEMANTIC_SIM": (0.70, "man"),
    "EXCERPT_WORK_MAX_COVERAGE": (0.40, "man"),
}
REGISTRY = MappingProxyType(_VALUES)

#: Outside the registry. Fixed values.
GATE_CONFIDENCE, GATE_LANGUAGE_SHARE, GATE_WINDOW_S = 0.60, 0.80, 30.0
LEGAL_RECOGNISABLE, LEGAL_MODIFIED, LEGAL_PASTICHE_RECOGNISABLE = 0.50, 0.40, 0.70
RANK_TIE = 0.02


def threshold(name: str, overrides: dict[str, float] | None = None) -> float:
    """The threshold's value; an unknown name is an error, there is no default."""
    if overrides and name in overrides:
        return overrides[name]
    return REGISTRY[name][0]
