"""Readers and writers of the tables, all through Spark's own file sources."""
