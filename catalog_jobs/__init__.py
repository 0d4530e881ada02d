"""Spark jobs that build, export and serve an item catalogue."""
