"""All registered queries over the driver tables."""

from . import cohort_queries, document_queries, entity_queries, event_queries, family_queries, further_queries, identity_queries, learning_queries, match_queries, rank_queries, request_queries, season_queries, selection_queries, source_queries, state_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
