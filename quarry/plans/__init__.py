"""All registered queries."""

from . import lexical, scalars, text, vectors  # noqa: F401 - they register themselves
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
