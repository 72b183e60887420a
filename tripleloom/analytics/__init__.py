"""Corpus classification and benchmark analytics over metadata and timing tables."""
