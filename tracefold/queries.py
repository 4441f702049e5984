"""The query catalogue: name to callable, and name to the equivalent SQL."""

from __future__ import annotations

from .plans import catalogue_events, catalogue_features, catalogue_fusion, catalogue_kernels, catalogue_matching, catalogue_runs, catalogue_sequences

_PARTS = (catalogue_sequences, catalogue_matching, catalogue_fusion, catalogue_kernels, catalogue_events, catalogue_runs, catalogue_features)

QUERIES: dict = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLES: dict = {k: v for part in _PARTS for k, v in part.ORACLES.items()}
