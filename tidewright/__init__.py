"""Tidewright: a Spark-first engine for building, analysing and ranking language-model data."""
