from liveops.plans import (  # noqa: F401
    catalog_queries, channel_queries, media_queries, packet_queries, source_queries,
    stored_queries,
)
from liveops.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
