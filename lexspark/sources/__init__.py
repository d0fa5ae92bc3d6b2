"""Schemas, landed upstream records, stored tables, the corpus derived for tests."""
