"""Explicit schemas of the tables the library reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

NARRATIVES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("article_text", T.StringType()),
    T.StructField("posting_time", T.TimestampType()),
    T.StructField("media_outlet", T.StringType()),
    T.StructField("inferred_actor", T.StringType()),
    T.StructField("strategic_intent", T.StringType()),
    T.StructField("sector", T.StringType()),
    T.StructField("tone", T.StringType()),
    T.StructField("target_country", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("prediction_source", T.StringType()),
    T.StructField("lang_detect", T.StringType()),
    T.StructField("use_afrolm", T.BooleanType()),
    T.StructField("llm_strat", T.StringType()),
    T.StructField("llm_strat_conf", T.DoubleType()),
    T.StructField("llm_strat_notes", T.StringType()),
    T.StructField("pseudo_kept", T.BooleanType()),
    T.StructField("pseudo_weight", T.DoubleType()),
    T.StructField("llm_strat_id", T.IntegerType()),
    T.StructField("strategic_intent_id", T.IntegerType()),
    T.StructField("author", T.StringType()),
    T.StructField("journalist_fk", T.LongType()),
    T.StructField("media_outlet_fk", T.LongType()),
    T.StructField("ml_processed_at", T.TimestampType()),
    T.StructField("is_anchor", T.BooleanType()),
    T.StructField("true_label", T.StringType()),
])

JOURNALIST_FIELDS = ["name", "city", "country_based", "nationality", "linkedin_profile",
                     "facebook_profile", "x_profile", "instagram_profile"]
OUTLET_FIELDS = ["name", "parent_organisation", "website", "country", "city",
                 "content_sharing_agreements", "linkedin_profile", "facebook_profile",
                 "x_profile", "instagram_profile"]

RISK_INDEX = T.StructType([
    T.StructField("actor", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("intent", T.StringType()),
    T.StructField("final_risk", T.DoubleType()),
])

STORY = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("publish_date", T.StringType()),
    T.StructField("media_name", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("actor", T.StringType()),
    T.StructField("target", T.StringType()),
])

MODEL_SCORES = T.StructType([
    T.StructField("article_id", T.LongType()),
    T.StructField("model", T.IntegerType()),
    T.StructField("class", T.IntegerType()),
    T.StructField("prob", T.DoubleType()),
    T.StructField("logit", T.DoubleType()),
])

EXPOSURE = "actor string, country string, metric string, value double"
COUNTRY_PROFILE = "country string, gdp double, fsi_raw double, lgbt_enforcement double, election_date string"
