"""Operators for building text-model training data; nothing else in the library imports this package."""
