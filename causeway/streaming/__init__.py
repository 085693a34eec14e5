"""Structured Streaming twins of the ordered folds."""
