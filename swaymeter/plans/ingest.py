"""From found stories to stored articles, with a reason for every story not stored."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swaymeter.functions.base import missing
from swaymeter.functions.labels import override_actor
from swaymeter.operators.filters import relevant, scrape_ok
from swaymeter.operators.joins import spread_key, surrogate_id
from swaymeter.operators.paging import capped
from swaymeter.operators.sets import first_per_key


@dataclass
class Ingested:
    articles: DataFrame
    rejects: DataFrame


def story_outcomes(stories: DataFrame, page_texts: DataFrame, store: DataFrame, order: Sequence[str],
                   min_chars: int = 1000, cap: int | None = None, row_id: str = "story_id") -> DataFrame:
    """Every story with an `outcome`: `saved` or why not.

    `stories` has a unique `row_id`; `page_texts` is (url, article_text), one row per url.
    """
    run = capped(stories, cap, *order).withColumn("_target", F.coalesce("target_country", F.lit("")))
    # stories without a url get keys of their own, so that they are not dealt to one task
    run = run.withColumn("_url", spread_key(F.col("url"), ~missing("url"), row_id))
    stored = store.filter(~missing("url")).select(F.col("url").alias("_url")).distinct().withColumn("_stored", F.lit(True))
    # texts are judged once per (url, target), however many stories share the url
    text = F.col("article_text")
    gate = (F.when(text.isNull(), F.lit("no page"))
            .when(~relevant("article_text", "_target"), F.lit("irrelevant"))
            .when(~scrape_ok("article_text"), F.lit("scrape error"))
            .when(F.length(text) <= min_chars, F.lit("too short")))
    verdicts = (run.filter(~missing("url")).select("url", "_target").distinct().join(page_texts, "url", "left")
                .select(F.col("url").alias("_url"), "_target", gate.alias("_gate")))
    joined = run.join(stored, "_url", "left").join(verdicts, ["_url", "_target"], "left")
    reason = (F.when(missing("url"), F.lit("no url")).when(F.col("_stored").isNotNull(), F.lit("already stored"))
              .otherwise(F.col("_gate")))
    judged = joined.withColumn("_reason", reason)
    # a copy counts as a duplicate only of a copy that was saved, so the gate comes first
    winners = first_per_key(judged.filter(F.col("_reason").isNull()).select("url", row_id, *order), "url",
                            list(order), row_id).select(row_id, F.lit(True).alias("_first"))
    outcome = F.coalesce("_reason", F.when(F.col("_first").isNull(), F.lit("duplicate in run")), F.lit("saved"))
    actor = override_actor("inferred_actor", "url", "media_outlet")
    return (judged.join(winners, row_id, "left").withColumn("outcome", outcome).withColumn("inferred_actor", actor)
            .drop("_first", "_stored", "_reason", "_gate", "_target", "_url"))


def ingest_stories(stories: DataFrame, page_texts: DataFrame, store: DataFrame, order: Sequence[str],
                   min_chars: int = 1000, cap: int | None = None, row_id: str = "story_id") -> Ingested:
    """New articles (id from the url, so a repeated run gives the same rows) and rejects."""
    done = story_outcomes(stories, page_texts, store, order, min_chars, cap, row_id)
    saved = done.filter(F.col("outcome") == "saved").join(page_texts, "url").withColumn("id", surrogate_id(F.col("url")))
    rejects = done.filter(F.col("outcome") != "saved").select(row_id, "url", "outcome")
    return Ingested(saved.drop("outcome"), rejects)
