"""Operators for large text corpora and for training data."""
