"""Operators for preparing training data: deduplication, mixing, scoring, search and tokenizing over ``documents`` and ``embeddings``."""
