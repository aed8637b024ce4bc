"""Queries over the driver's tables: one per operator, with its SQL where SQL can say it."""

from checks import learning, outlines, relational, spatial  # noqa: F401  (register)
from checks.base import REGISTRY

__all__ = ["REGISTRY"]
