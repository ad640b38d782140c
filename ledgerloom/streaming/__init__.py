"""Structured Streaming over the inference log and arriving documents."""
