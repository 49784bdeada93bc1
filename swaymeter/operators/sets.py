"""Distinct rows, differences, unions and duplicates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_tagged(parts: Sequence[tuple[str, str, DataFrame]]) -> DataFrame:
    """One table of several story lists, tagged with their (target, actor)."""
    tagged = [d.withColumn("target", F.lit(t)).withColumn("actor", F.lit(a)) for t, a, d in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def names_without_profile(df: DataFrame, column: str, profiles: DataFrame, name: str = "name") -> DataFrame:
    """Distinct non-empty names that no profile has, exact spelling."""
    used = df.filter(F.col(column) != "").select(F.col(column).alias(name)).distinct()
    return used.join(profiles.select(name).distinct(), name, "left_anti")


def first_per_key(df: DataFrame, key: str, order: Sequence[str], row_id: str = "id") -> DataFrame:
    """One row per key: the first in `order`. Rows with a NULL key are dropped.

    The choice is made on ids by a combinable minimum, then the chosen ids fetch their
    rows. So a key that many rows share is never gathered in one task, and no text is
    shuffled to make the choice.
    """
    order = list(dict.fromkeys([*order, row_id]))
    first = F.min(F.struct(*order))[row_id] if len(order) > 1 else F.min(row_id)
    winners = df.filter(F.col(key).isNotNull()).groupBy(key).agg(first.alias(row_id)).select(row_id)
    return df.join(winners, row_id, "left_semi")


def split_by(df: DataFrame, condition) -> tuple[DataFrame, DataFrame]:
    """Rows for which the condition holds, and all others."""
    holds = F.coalesce(condition, F.lit(False))
    return df.filter(holds), df.filter(~holds)
