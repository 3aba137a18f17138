"""Structured Streaming views of a running pipeline."""
