"""Streams of queries against a fixed table of vectors."""
