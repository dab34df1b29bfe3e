"""All registered queries."""

from tidebook.plans import catalog_ledger, catalog_metrics, catalog_orders  # noqa: F401
from tidebook.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
