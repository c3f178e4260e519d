"""Structured Streaming: incremental bundle ingestion."""
