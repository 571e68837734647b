"""Operators for preparing language-model training data, and the queries that apply them."""
