"""Operators for training data and language-model logs."""
