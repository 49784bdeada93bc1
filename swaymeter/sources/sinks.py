"""Writers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swaymeter.operators.maintain import keyed_update


def append_articles(df: DataFrame, path: str) -> None:
    """Append to the article table, partitioned by month of posting.

    Rows are brought together by month first, so a month gets few files; Spark splits a month that is too large for one.
    """
    df.withColumn("month", month_of()).hint("rebalance", "month").write.mode("append").partitionBy("month").parquet(path)


def month_of() -> Column:
    return F.coalesce(F.date_format("posting_time", "yyyy-MM"), F.lit("undated"))


#: Months that one update may touch.
MAX_MONTHS = 12_000


def update_months(spark: SparkSession, path: str, updates: DataFrame, columns: Sequence[str], key: str = "id",
                  order: str | None = None) -> list[str]:
    """`maintain.keyed_update` of the stored articles (see `append_articles`) in place: only the months that hold an updated
    row are read, shuffled and written again. Returns these months.

    An updated posting time moves a row to its new month, which is then written again as well. The new months are complete
    in a folder beside the table before they replace the old ones, month by month; if that breaks off, the same update can
    be run again.
    """
    store = _stored(spark, path)
    wanted = updates.select(key).filter(F.col(key).isNotNull()).distinct()
    held = store.select(key, "posting_time", "month").join(wanted, key)
    old = _months(held.select("month"))
    if not old:
        return []
    new: list[str] = []
    if "posting_time" in columns:
        moved = keyed_update(held, updates, ["posting_time"], key, order)
        new = _months(moved.select(month_of().alias("month")))
    return _rewrite(spark, path, store, sorted({*old, *new}), lambda df: keyed_update(df, updates, columns, key, order))


def change_months(spark: SparkSession, path: str, wanted: Column, change: Callable[[DataFrame], DataFrame]) -> list[str]:
    """`change` applied to the stored articles in place, in the months that hold a row for which `wanted` is true; only
    such rows may change. Returns the months written again, also those to which rows have moved."""
    store = _stored(spark, path)
    some = store.filter(F.coalesce(wanted, F.lit(False)))
    old = _months(some.select("month"))
    if not old:
        return []
    new = _months(change(some).select(month_of().alias("month")))
    return _rewrite(spark, path, store, sorted({*old, *new}), change)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    columns = [f for f in spark.read.parquet(path).schema if f.name != "month"]
    return spark.read.schema(T.StructType([*columns, T.StructField("month", T.StringType())])).parquet(path)


def _months(df: DataFrame) -> list[str]:
    found = [r["month"] for r in df.distinct().limit(MAX_MONTHS + 1).collect()]
    if len(found) > MAX_MONTHS:
        raise ValueError(f"more than {MAX_MONTHS} months")
    return found


def _rewrite(spark: SparkSession, path: str, store: DataFrame, months: list[str], change: Callable[[DataFrame], DataFrame]) -> list[str]:
    beside = f"{path.rstrip('/')}-update-{uuid.uuid4().hex}"
    changed = change(store.filter(F.col("month").isin(months))).withColumn("month", month_of())
    changed.hint("rebalance", "month").write.partitionBy("month").parquet(beside)
    ready = spark.read.schema(store.schema).parquet(beside)
    left = set(_months(ready.select("month")))
    ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    for month in set(months) - left:  # all its rows have moved on
        ready.drop("month").limit(0).write.mode("overwrite").parquet(f"{path}/month={month}")
    return months


def replace_table(df: DataFrame, path: str) -> str:
    """Write a new version, then point the table at it. Readers see the old or the new, never a mix.

    The pointer is appended last; a failed or repeated write leaves the old version current.
    """
    spark = df.sparkSession
    version = uuid.uuid4().hex
    df.write.mode("error").parquet(f"{path}/data/{version}")
    pointer = spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("written_at"))
    pointer.coalesce(1).write.mode("append").parquet(f"{path}/current")
    return version


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The version the pointer names."""
    latest = spark.read.parquet(f"{path}/current").orderBy(F.desc("written_at"), "version").first()
    return spark.read.parquet(f"{path}/data/{latest['version']}")


def write_backup(predictions: DataFrame, path: str) -> None:
    """Predictions as CSV; rows that failed stay, with their error."""
    status = F.when(F.col("error").isNull(), F.lit("SUCCESS")).otherwise(F.lit("FAILED"))
    predictions.withColumn("status", status).write.mode("overwrite").option("header", True).csv(path)


def write_panels(panels: Mapping[str, DataFrame], folder: str, kind: str = "json") -> None:
    """One table per report panel."""
    for name, panel in panels.items():
        panel.write.mode("overwrite").format(kind).save(f"{folder}/{name}")
