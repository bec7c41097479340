"""Operators by node type."""

from . import columns, combine, rows
from .base import OPERATORS

__all__ = ["OPERATORS", "columns", "combine", "rows"]
