"""Composed jobs, tables derived from the given ones, and the query catalogue."""
