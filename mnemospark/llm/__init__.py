"""Operators on text for training data. Nothing outside this package imports it."""
