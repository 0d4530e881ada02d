"""Readers of fetched pages and feeds, and the lists of urls to fetch."""
