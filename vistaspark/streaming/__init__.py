"""Incremental scoring of a growing image set."""
