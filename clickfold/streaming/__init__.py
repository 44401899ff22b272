"""Structured Streaming ingest and the tables it maintains."""
