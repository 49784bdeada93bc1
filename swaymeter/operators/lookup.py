"""Lookup tables that travel with every task, after their rows have been counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a lookup table that is sent to every task; an index has a few hundred (actors times countries).
MAX_LOOKUP = 100_000


def small(table: DataFrame, most: int = MAX_LOOKUP) -> DataFrame:
    """A lookup table marked for broadcast if it has at most `most` rows; beyond that Spark joins as it sees fit.

    The table is kept while it is counted, so that the join does not compute it a second time.
    """
    kept = table.persist()
    if kept.limit(most + 1).count() <= most:
        return F.broadcast(kept)
    kept.unpersist()
    return table
