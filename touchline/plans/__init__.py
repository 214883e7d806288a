"""Queries over the derived tables, each with its checking SQL."""
