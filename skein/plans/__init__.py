"""Corpora made of tables, and the registry of queries."""
