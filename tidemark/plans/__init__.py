"""Queries over the given tables."""

from . import queries, cue_queries, event_queries, rank_queries, box_queries, set_queries, stream_queries, match_queries, seat_queries, live_queries, rule_queries, system_queries, binary_queries  # noqa: F401, I001
