"""Registered queries with the SQL they are checked against."""

from wayloom.plans import answers, cleaning, corridors, files, matching, regions, retrieval, roads, routes, trips
from wayloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "answers", "cleaning", "corridors", "files", "matching", "regions", "retrieval", "roads", "routes", "trips"]
