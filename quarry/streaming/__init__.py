"""Stored queries and windows over streams."""
