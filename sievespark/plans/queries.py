"""Imports every module that registers queries."""

from . import queries_io, queries_sets, queries_use  # noqa: F401
from .catalogue import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
