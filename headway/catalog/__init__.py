"""Every operator bound to the given tables, with the same question in plain SQL."""

from headway.catalog.base import ORACLES, QUERIES
from headway.catalog import (  # noqa: F401
    aggs, feeds, filters, joining, learned, live, samples, sets, views, windowed,
)

__all__ = ["ORACLES", "QUERIES"]
