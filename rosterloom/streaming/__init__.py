"""Structured Streaming variants of ingestion."""
