"""All registered queries."""

from pageloom.plans import (  # noqa: F401  (importing registers)
    item_queries, page_queries, request_queries, site_queries,
)
from pageloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
