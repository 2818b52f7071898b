"""Composed reports and the query catalogue."""
