"""Matching a stream of names against a static pool."""
