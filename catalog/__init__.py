"""Registered queries and the SQL that checks them."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from swaymeter.operators.paging import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
CHECKS: dict[str, tuple[Query, str | None]] = {}


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL that must give the same rows."""
    def add(query: Query) -> Query:
        if name in CHECKS:
            raise ValueError(f"{name} is registered twice")
        CHECKS[name] = (query, sql)
        return query

    return add


def work_folder(spark: SparkSession) -> str:
    """Folder for the files that queries write: the session's shared folder, or one made here for a session on one machine."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="swaymeter-"))
    return shared_folder(spark)


def load() -> dict[str, tuple[Query, str | None]]:
    from catalog import (aggregates, filters, joins, labels, maintenance, reports, risk, scores,  # noqa: F401
                         sources, streams, texts)

    return CHECKS
