"""Structured Streaming jobs (S01-S05), each with a batch twin."""
