"""Operators for training-data pipelines: tokens, search, mixing, quality, fingerprints, archives."""
