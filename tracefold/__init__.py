"""Spark-native content provenance operators."""
