"""Streaming forms of time-driven operators."""
