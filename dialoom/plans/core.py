"""Queries of the reference operators over the driver tables."""

from dialoom.plans import clients, conversations, randoms, rewards, texts, usage  # noqa: F401
