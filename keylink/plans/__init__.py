"""Whole pipelines assembled from the operators."""
