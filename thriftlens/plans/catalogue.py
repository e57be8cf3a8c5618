"""Imports every module that registers queries."""

from thriftlens.plans import (  # noqa: F401
    board_queries,
    ladder_queries,
    market_queries,
    peer_queries,
    sample_queries,
    scalar_queries,
    stream_queries,
    track_queries,
    trade_queries,
)
from thriftlens.plans.registry import QUERIES

FLAGSHIP = QUERIES["undervalued_shortlist"]
