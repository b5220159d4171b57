"""All registered queries."""

from flightline.plans import event_queries, geometry_queries, match_queries, cleaning_queries, track_queries, feature_queries, attribution_queries, score_queries, stream_queries  # noqa: F401
from flightline.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
