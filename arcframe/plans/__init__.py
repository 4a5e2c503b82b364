"""Logical plans of written archives."""

from .archive import planned, validated

__all__ = ["planned", "validated"]
