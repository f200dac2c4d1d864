"""Registered queries of the reference's operators over the driver's tables, with their SQL."""

from scoutline.plans import grid_queries, identity_queries, lifecycle_queries, queue_queries, relation_queries, score_queries, text_queries

PLANS = (score_queries, relation_queries, identity_queries, text_queries, lifecycle_queries, queue_queries, grid_queries)
