"""Incremental ingest: new node files as they come in."""
