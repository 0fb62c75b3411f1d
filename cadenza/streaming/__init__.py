"""Structured Streaming forms of the lane operators."""
