"""Operators for preparing very large text corpora. Nothing else in the library imports this package."""
