"""Spark jobs for large collections of mail archives."""
