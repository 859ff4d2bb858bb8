"""Queries over the driver tables, one per operator, each with its SQL twin where SQL can say it."""

from cohortlake.plans import connectivity, evaluation_queries, feature_queries, idset_queries, series_queries, source_queries, voxel_queries  # noqa: F401
from cohortlake.plans.base import REGISTRY

__all__ = ["REGISTRY"]
