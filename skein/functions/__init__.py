"""Expressions and small numeric helpers."""
