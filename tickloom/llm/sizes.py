"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000  # rows of a few numbers, some ten megabytes as a hash table


def small_side(keys: DataFrame) -> DataFrame:
    """``keys`` (computed, a few numbers a row) marked for broadcast when it is small; a shuffle join otherwise.

    The large side of a join then moves only when the small one has outgrown the bound.
    """
    return F.broadcast(keys) if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else keys
