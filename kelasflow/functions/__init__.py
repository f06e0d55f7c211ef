"""Column-level helpers: predicates, list aggregation, join sizing, derived columns."""
