"""Registered queries over the given tables, each with its reference SQL."""

from aftershock.catalog import joins, models, scalars, scans, windows  # noqa: F401
from aftershock.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
