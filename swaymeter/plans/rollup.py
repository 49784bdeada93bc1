"""A kept roll-up of the articles, and the overview panels from it.

One row per (day, country, actor, intent, outlet, about sports) with the number of articles and their confidence. Counts
add up, so each batch of the ingest writes the counts of its own rows to a folder of its own (replaced if the batch is
repeated, and a late article simply counts on its day), and readers add them. `merge` folds the folders into one table from
time to time. No panel here reads an article or a text.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swaymeter import fixed_values as V
from swaymeter.functions.base import contains_any, iexact, to_day
from swaymeter.operators import filters as P
from swaymeter.plans.reports import Panels, cards_of, contextual_score
from swaymeter.functions.labels import canonical_intent
from swaymeter.sources.sinks import read_current, replace_table

KEYS = ["day", "target_country", "inferred_actor", "strategic_intent", "media_outlet", "about_sports"]
#: Confidence is added exactly, so that the order of the batches cannot show.
EXACT = "decimal(38,12)"


def _sums() -> list:
    return [F.sum("n").alias("n"), F.sum("conf").cast(EXACT).alias("conf"), F.sum("n_conf").alias("n_conf")]


def counts(articles: DataFrame) -> DataFrame:
    """The roll-up of `articles`: every article counts in exactly one row, whatever its columns miss."""
    about_sports = F.coalesce(contains_any("article_text", V.SPORTS_WORDS), F.lit(False))
    rows = articles.select(to_day("posting_time").alias("day"), *KEYS[1:5], about_sports.alias("about_sports"),
                           F.col("confidence").cast(EXACT).alias("c"))
    return rows.groupBy(*KEYS).agg(F.count("*").alias("n"), F.coalesce(F.sum("c"), F.lit(0)).cast(EXACT).alias("conf"), F.count("c").alias("n_conf"))


def write_counts(articles: DataFrame, folder: str) -> None:
    """The roll-up of one batch, in the folder of that batch."""
    counts(articles).write.mode("overwrite").parquet(folder)


def _batches(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path).withColumn("run", F.col("run").cast("string"))
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def merge(spark: SparkSession, path: str, merged_path: str) -> None:
    """Fold all batches of `path` into a new version of the table at `merged_path`, which also keeps which batches are in it.

    Readers see the old version until the new one is complete. A batch must not run again once it is merged: it would not
    be taken a second time.
    """
    found = _batches(spark, path)
    if found is None:
        return
    sums = read(spark, path, merged_path).withColumns({"run": F.lit(None).cast("string"), "batch": F.lit(None).cast("int")})
    done = found.select("run", F.col("batch").cast("int").alias("batch")).distinct()
    replace_table(sums.unionByName(done, allowMissingColumns=True), merged_path)


def read(spark: SparkSession, path: str, merged_path: str | None = None) -> DataFrame:
    """The roll-up: what was merged, and every batch since, added up."""
    found = _batches(spark, path)
    merged = None
    if merged_path:
        try:
            merged = read_current(spark, merged_path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    if merged is not None:
        taken = merged.where("run is not null").select("run", "batch")
        found = found.join(taken, ["run", "batch"], "left_anti")
        found = found.drop("run", "batch").unionByName(merged.where("run is null").drop("run", "batch"))
    return found.groupBy(*KEYS).agg(*_sums())


def overview_base(rollup: DataFrame, country: str | None = None, actor: str | None = None, intent: str | None = None) -> DataFrame:
    """Counts of articles about monitored countries that are not about sports."""
    return P.matching(rollup.filter(P.monitored() & ~F.col("about_sports")), country, actor, intent)


def latest_volume(rollup: DataFrame, n: int = 500) -> DataFrame:
    """Daily volume of the `n` latest dated articles only, oldest day first.

    Every day has an article, so these lie in the `n` latest days; the running count over those days needs one small task.
    """
    days = rollup.filter("day is not null").groupBy("day").agg(F.sum("n").alias("n")).orderBy(F.desc("day")).limit(n)
    later = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shown = days.select("day", F.least(F.col("n"), F.lit(n) - later).alias("count"))
    return shown.filter("count > 0").orderBy("day")


def _top(base: DataFrame, *keys: str, n: int) -> DataFrame:
    return base.groupBy(*keys).agg(F.sum("n").alias("total")).orderBy(F.desc("total"), *[F.asc_nulls_last(k) for k in keys]).limit(n)


def overview(rollup: DataFrame, index: DataFrame, country: str | None = None, actor: str | None = None,
             intent: str | None = None) -> Panels:
    """The counting panels of the overview page, equal to those of `reports.overview`, without reading an article."""
    base = overview_base(rollup, country, actor, intent)
    risk = index
    risk = risk.filter(iexact("country", country)) if country else risk
    risk = risk.filter(iexact("actor", actor)) if actor else risk
    panels = {
        "cards": lambda: cards_of(base.withColumn("conf", F.col("conf").cast("double")), risk),
        "volume": lambda: latest_volume(base),
        "countries": lambda: _top(base.filter(P.no_placeholder("target_country")), "target_country", n=10),
        "subjects": lambda: _top(base.filter(P.no_placeholder("strategic_intent", [""])), "strategic_intent", "inferred_actor",
                                 "target_country", n=5).withColumn("canonical_intent", canonical_intent("strategic_intent")),
    }
    if country and actor:
        panels["score"] = lambda: contextual_score(index, country, actor, intent)
    return Panels(**panels)


def daily_volume(rollup: DataFrame) -> DataFrame:
    """Articles per day, oldest day first; undated ones do not count."""
    return rollup.filter("day is not null").groupBy("day").agg(F.sum("n").alias("count")).orderBy("day")
