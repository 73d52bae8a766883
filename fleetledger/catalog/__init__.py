"""Every named query over the test tables, with the SQL that checks it."""

from fleetledger.catalog import artifacts, budget, evidence, history, lint, memory, paths, plans, references, sessions, units  # noqa: F401
from fleetledger.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
