"""Registered queries over the test tables, with SQL oracles where SQL can express the result."""

from catalog.base import ORACLES, QUERIES
from catalog import steps  # noqa: F401
from catalog import clean, shared, suite, access, overview, events, panels, stats, models, network, relational, storage  # noqa: F401

__all__ = ["QUERIES", "ORACLES"]
