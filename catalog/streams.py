"""The streams, run over the events table until everything is taken."""

import uuid

from pyspark.sql import functions as F

from catalog import check, work_folder
from catalog.views import FACTS, oracle, table, view
from swaymeter.operators.joins import score_cascade
from swaymeter.streaming import streams as S



def events_stream(spark, d):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    raw = S.story_stream(spark, d, table(spark, d, "events").schema, "parquet", "events.parquet")
    return spark.sql(FACTS.replace("FROM events", "FROM {e}"), e=raw)


def folders(spark):
    base = f"{work_folder(spark)}/stream-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/checkpoint"


@check("stream_ingest", oracle("SELECT id, url FROM facts", "facts"))
def _(spark, d):
    out, checkpoint = folders(spark)
    S.run_once(events_stream(spark, d).select("id", "url"), out, checkpoint)
    return spark.read.parquet(out)


@check("stream_dedup", oracle("""
SELECT url, FALSE AS undated FROM (SELECT DISTINCT url FROM facts WHERE url IS NOT NULL AND posting_time IS NOT NULL)
UNION ALL SELECT url, TRUE FROM facts WHERE url IS NOT NULL AND posting_time IS NULL""", "facts"))
def _(spark, d):
    out, checkpoint = folders(spark)
    kept = S.dedup_stream(events_stream(spark, d)).select("url", F.col("posting_time").isNull().alias("undated"))
    S.run_once(kept, out, checkpoint)
    return spark.read.parquet(out)


@check("stream_daily_volume", oracle("""
SELECT day, count FROM (SELECT CAST(posting_time AS DATE) AS day, count(*) AS count FROM facts WHERE posting_time IS NOT NULL GROUP BY 1)
WHERE CAST(day AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(posting_time) - INTERVAL 2 DAY FROM facts)""", "facts"))
def _(spark, d):
    out, checkpoint = folders(spark)
    S.run_once(S.daily_volume_stream(events_stream(spark, d)), out, checkpoint)
    return spark.read.parquet(out)


@check("stream_store_and_score", oracle("""
, first AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id) AS rn FROM facts WHERE url <> '')
SELECT id, url, target_country, TRUE AS scored FROM first WHERE rn = 1""", "facts"))
def _(spark, d):
    out, checkpoint = folders(spark)
    index = view(spark, d, "idx")
    S.run_batches(events_stream(spark, d), S.store_writer(out, ["id"], transform=lambda b: score_cascade(b, index)), checkpoint)
    return S.read_store(spark, out).select("id", "url", "target_country", F.col("score").isNotNull().alias("scored"))
