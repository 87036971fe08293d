"""Operators for training-data pipelines over language-model corpora. Nothing outside this package imports it."""
