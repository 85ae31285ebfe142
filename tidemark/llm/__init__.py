"""Operators for text and records of language-model training data; nothing outside imports this package."""
