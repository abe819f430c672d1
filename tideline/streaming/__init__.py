"""Structured Streaming forms of the causal indicators."""
