"""Registered queries: the Spark job per operator id and its DuckDB oracle."""
