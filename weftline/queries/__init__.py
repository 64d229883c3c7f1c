"""Registered queries over the driver's tables and over fixtures."""

from weftline.queries import counts, fixture_queries, joins, maths, pages, prose, sites, streams, traces  # noqa: F401
from weftline.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
