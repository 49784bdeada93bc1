"""Grouped counts, means and picks.

Every operator is a plain `groupBy`, which Spark combines before the shuffle, so a key
holding a third of all rows costs each task one row. Picks ("best", "first", "most
frequent") are min/max aggregates, not windows, for the same reason.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swaymeter.functions.base import ColumnOrName, col, to_day


def count_by(df: DataFrame, *keys: str, name: str = "count") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def top_counts(df: DataFrame, *keys: str, n: int | None = None, name: str = "count") -> DataFrame:
    """Most frequent key combinations; ties in key order."""
    ranked = count_by(df, *keys, name=name).orderBy(F.desc(name), *[F.asc_nulls_last(k) for k in keys])
    return ranked if n is None else ranked.limit(n)


def shown_ascending(df: DataFrame, name: str = "count", *keys: str) -> DataFrame:
    """A top list in the order of a horizontal bar chart."""
    return df.orderBy(F.asc(name), *[F.asc_nulls_last(k) for k in keys])


def distinct_values(c: ColumnOrName) -> Column:
    """Number of distinct values, NULL being one of them."""
    c = col(c)
    return F.count_distinct(c) + F.max(F.when(c.isNull(), 1).otherwise(0))


def breadth(df: DataFrame, key: str) -> DataFrame:
    """Articles, countries and actors per key, and the total over all keys.

    Distinct values are counted on the small table of combinations, not on the articles.
    """
    combos = count_by(df, key, "target_country", "inferred_actor", name="_n")
    per_key = combos.groupBy(key).agg(
        F.sum("_n").alias("count"),
        F.count_distinct("target_country").alias("countries"),
        F.count_distinct("inferred_actor").alias("actors"))
    return with_total(per_key, "count", "total")


def with_total(counts: DataFrame, count: str, name: str) -> DataFrame:
    """The sum of the counts next to each of them: one number, from the groups alone, which stay where they are."""
    return counts.withColumn(name, counts.agg(F.sum(count)).scalar())


def mean_confidence(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("articles"), F.avg("confidence").alias("avg_confidence"))


def mean_risk(index: DataFrame, *keys: str) -> DataFrame:
    return index.groupBy(*keys).agg(F.avg("final_risk").alias("avg_risk"))


def max_risk(index: DataFrame, *keys: str) -> DataFrame:
    return index.groupBy(*keys).agg(F.max("final_risk").alias("max_risk"))


def daily_volume(df: DataFrame, time: str = "posting_time") -> DataFrame:
    """Articles per UTC day, oldest day first; rows without a time do not count."""
    return (df.filter(F.col(time).isNotNull()).groupBy(to_day(time).alias("day"))
            .agg(F.count("*").alias("count")).orderBy("day"))


def latest_volume(df: DataFrame, n: int = 500, time: str = "posting_time") -> DataFrame:
    """Daily volume of the n latest dated rows only."""
    latest = (df.filter(F.col(time).isNotNull()).select("id", time)
              .orderBy(F.desc(time), "id").limit(n))
    return daily_volume(latest, time)


def pick_best(df: DataFrame, keys: Sequence[str], order: Sequence[Column], values: Sequence[str]) -> DataFrame:
    """`values` of the row that comes first in `order`, per key.

    `order` columns must sort ascending (negate numbers for descending).
    """
    best = F.min_by(F.struct(*values), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{v}").alias(v) for v in values])


def most_frequent(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Most frequent value per key with its count; ties go to the smaller value."""
    counts = count_by(df, *keys, value)
    return pick_best(counts, keys, [-F.col("count"), F.col(value)], [value, "count"])


def best_risk(index: DataFrame, *keys: str) -> DataFrame:
    """Highest risk per key and the intent it belongs to; ties in intent order."""
    return pick_best(index, keys, [-F.col("final_risk"), F.col("intent")], ["final_risk", "intent"])


def share_of(condition: Column) -> Column:
    """Share of rows for which the condition holds, 0 for no rows."""
    return F.coalesce(F.try_divide(F.count_if(condition).cast("double"), F.count("*")), F.lit(0.0))


def author_stats(df: DataFrame, min_articles: int = 1) -> DataFrame:
    """Articles and mean confidence per author with at least `min_articles`."""
    return mean_confidence(df, "author").filter(F.col("articles") >= min_articles)


def relative_to_max(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Value over the largest one of its group; 0 where that is not positive. For groups of any size."""
    top = df.groupBy(*keys).agg(F.max(value).alias("_max"))
    ratio = F.when(F.col("_max") > 0, F.col(value) / F.col("_max")).otherwise(F.lit(0.0))
    return df.join(top, list(keys), "left").withColumn(name, ratio).drop("_max")


def weight_in_group(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Value over the group's sum; equal weights where the sum is 0. For groups of any size."""
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum"), F.count("*").alias("_n"))
    weight = F.when(F.col("_sum") == 0, F.lit(1.0) / F.col("_n")).otherwise(F.col(value) / F.col("_sum"))
    return df.join(sums, list(keys), "left").withColumn(name, weight).drop("_sum", "_n")


def collection_health(stories: DataFrame, collections: DataFrame, key: str) -> DataFrame:
    """Stories per collection; collections without any count 0."""
    found = count_by(stories, key, name="stories")
    return collections.select(key).join(found, key, "left").withColumn("stories", F.coalesce("stories", F.lit(0)))


def outcome_summary(df: DataFrame, status: str) -> DataFrame:
    """Rows per outcome and their share in percent."""
    counts = with_total(count_by(df, status), "count", "_total")
    return counts.withColumn("percent", F.round(F.col("count") * 100.0 / F.col("_total"), 1)).drop("_total")
