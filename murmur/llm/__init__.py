"""Operators of a large training-data pipeline: filters, copies, fingerprints, tokens, shards, scores.

Nothing else in the library imports this package. `queries` registers one query per operator."""
