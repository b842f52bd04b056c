"""Structured Streaming over run traces."""
