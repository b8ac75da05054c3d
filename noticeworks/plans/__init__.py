"""All queries of the library, by name, with SQL that gives the same rows."""

from noticeworks.plans import aggregates, collected, ingest, listings, scoring, writes  # noqa: F401
from noticeworks.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
