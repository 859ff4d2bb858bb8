"""Broadcast only what has been counted."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def small(df: DataFrame, rows: int = 2_000_000) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``rows`` rows (narrow ones); else as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
