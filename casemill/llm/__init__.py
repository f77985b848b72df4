"""Operators for training data made of clinical texts. Nothing else in the library imports this package."""
