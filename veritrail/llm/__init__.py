"""Operators and queries for training data; nothing else in the library imports them."""

from veritrail.llm.queries import registry

__all__ = ["registry"]
