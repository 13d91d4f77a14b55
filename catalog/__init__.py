"""Registered queries with their DuckDB equivalents, by subject."""
