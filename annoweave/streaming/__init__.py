"""Structured Streaming: incremental ingest and prediction."""
