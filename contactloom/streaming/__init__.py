"""Incremental delivery with Structured Streaming."""
