"""Incremental indexing of files as they arrive."""
