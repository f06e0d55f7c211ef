"""Inputs: the learning-schema catalog, parquet/JDBC IO and the test mapping."""
