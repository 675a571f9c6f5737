"""Importing the plan modules fills the registry."""

from murmur.plans import dedup, events, features, graphs, heat, hooks, sentiment, served, sources, streams, text  # noqa: F401
from murmur.plans.registry import ORACLE, QUERIES  # noqa: F401
