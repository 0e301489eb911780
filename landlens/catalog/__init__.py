"""The registered queries."""

from landlens.catalog.base import REGISTRY, Query
from landlens.catalog import geo_queries, market_queries, cell_queries, spatial_queries  # noqa: F401, I001
from landlens.catalog import raster_queries, terrain_queries, risk_queries, profile_queries, plan_queries  # noqa: F401

__all__ = ["REGISTRY", "Query"]
