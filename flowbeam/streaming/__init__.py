"""Structured Streaming ingest of capture files arriving in a landing directory."""
