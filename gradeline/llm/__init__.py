"""Operators for training-data corpora: text, pages and vectors at scale."""
