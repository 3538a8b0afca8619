"""Operators for preparing language-model training data; ``queries`` registers one query for each."""
