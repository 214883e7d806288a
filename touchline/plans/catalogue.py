"""All registered queries."""

from touchline.plans import (  # noqa: F401
    detection_queries,
    export_queries,
    fit_queries,
    ingest_queries,
    live_queries,
    minute_queries,
    pass_queries,
    piece_queries,
    pitch_queries,
    reid_queries,
    scalar_queries,
    stored_queries,
    team_queries,
    track_queries,
)
from touchline.plans.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
