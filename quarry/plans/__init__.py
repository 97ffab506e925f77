"""Queries over the driver tables, grouped by operator family."""
