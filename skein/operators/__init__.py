"""Operators on notes and graphs."""
