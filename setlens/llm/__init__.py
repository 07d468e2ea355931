"""Operators that prepare training data for language and retrieval models."""
