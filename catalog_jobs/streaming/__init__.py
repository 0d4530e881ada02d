"""Streams of crawled files."""
