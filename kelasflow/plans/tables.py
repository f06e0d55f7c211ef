"""Per-session cache of the learning tables derived from a test directory."""

from __future__ import annotations

from pyspark.sql import SparkSession

from kelasflow.sources.catalog import Tables
from kelasflow.sources.fixtures import fixture_tables

_CACHE: dict[str, Tables] = {}


def tables_for(spark: SparkSession, sf_dir: str) -> Tables:
    """Derived tables for ``sf_dir``, rebuilt whenever the session differs
    from the one they were built with (a stopped and recreated session never
    sees frames of the old one)."""
    cached = _CACHE.get(sf_dir)
    if cached is None or cached.spark is not spark:
        cached = _CACHE[sf_dir] = fixture_tables(spark, sf_dir)
    return cached
