"""Structured Streaming forms of the normalization and exact-copy steps."""
