"""Incremental runs of batch operators."""
