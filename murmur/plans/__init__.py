"""Composed queries over the given tables together with their SQL counterparts."""
