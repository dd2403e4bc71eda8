"""Structured Streaming twins of the folds."""
