"""Compositions of operators: searches, slices and overviews."""
