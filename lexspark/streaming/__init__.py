"""Incremental load as a stream of landed files."""
