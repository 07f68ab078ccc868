"""Imports every module that registers queries."""

from boutique.plans import (  # noqa: F401
    allocation_queries,
    maintenance_queries,
    profile_queries,
    quality_queries,
    sequence_queries,
    shop_queries,
    streaming_queries,
)
