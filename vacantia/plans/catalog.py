"""All registered queries."""

from vacantia.plans import enrich, ingest, reports  # noqa: F401
from vacantia.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
