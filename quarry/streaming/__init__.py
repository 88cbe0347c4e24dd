"""Structured Streaming forms of ingestion and of its metrics."""
