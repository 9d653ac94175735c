"""Corpus operators for training-data preparation."""
