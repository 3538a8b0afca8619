"""Recommendation, signal and evaluation plans built from the operators."""
