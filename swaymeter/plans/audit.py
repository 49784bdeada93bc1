"""Data-quality questions about the article table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swaymeter.operators import filters as P
from swaymeter.operators.aggregates import count_by
from swaymeter.operators.paging import latest


def quality_profile(df: DataFrame) -> DataFrame:
    """One row: articles, corrupt texts, labelled and unlabelled articles, mean text length."""
    return df.agg(F.count("*").alias("total"), F.count_if(P.corrupt()).alias("corrupt"),
                  F.count_if(P.labelled()).alias("labelled"), F.count_if(P.unlabelled()).alias("unlabelled"),
                  F.avg(F.length("article_text")).alias("mean_chars"))


def audit(df: DataFrame, as_of: str, term: str = "Israel", outside: tuple[str, ...] = ("SA",),
          cutoff: str = "2023-10-16") -> dict[str, DataFrame]:
    """The audit panels by name."""
    recent = df.filter(P.since("posting_time", as_of, 1))
    sample = ["id", "posting_time", "target_country", "inferred_actor", "media_outlet", "url"]
    return {
        "profile": quality_profile(df),
        "latest": latest(df, 5).select(*sample, F.length("article_text").alias("chars")),
        "recent_pairs": count_by(recent, "target_country", "inferred_actor").orderBy("target_country",
                                                                                     "inferred_actor"),
        "recent_text": recent.filter(P.longer_than("article_text", 500)).orderBy("id").limit(1).select("id", "article_text"),
        "off_target": recent.filter(P.term_outside_country(term, outside)).select(*sample),
        "corrupt": df.filter(P.corrupt()).orderBy("id").limit(3).select(*sample, "article_text"),
        "old_without_target": df.filter(P.old_without_target(cutoff)).agg(F.count("*").alias("count")),
        "old_sample": df.filter(P.old_without_target(cutoff)).orderBy("id").limit(1).select(*sample),
    }
