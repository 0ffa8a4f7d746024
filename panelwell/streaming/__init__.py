"""Structured Streaming twins of the bin sums and of response deduplication."""
