"""Adapters, compositions of operators, and the query catalogue."""
