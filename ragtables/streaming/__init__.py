"""Structured Streaming forms of ingest, conversation memory and answer checks."""
