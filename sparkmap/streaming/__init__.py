"""Incremental ingest of recording runs."""
