"""Registered queries over the driver tables, each with its SQL where SQL can express it."""

from quern.plans import battles, calls, dataset, docs, feeds, io, results, search, textsim, tools  # noqa: F401  they register their queries
from quern.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
