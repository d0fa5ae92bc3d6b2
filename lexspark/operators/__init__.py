"""Relational building blocks: index, matching, scoring, filters, ranking."""
