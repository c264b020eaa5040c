"""Readers: flow tables, documents, keyed tables, capture files, result sets, query specs."""
