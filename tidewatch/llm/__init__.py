"""Corpus operators for training data: tokenising, filtering, mixing, deduplication and scoring."""
